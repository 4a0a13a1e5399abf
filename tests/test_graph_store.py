"""The kept graph, brought up to date, against a full build."""

import random

from graphloom.operators.graph_store import GraphStore

FILE = "path string, text string, language string"


def source(i, rng, names):
    calls = " ".join(f"{rng.choice(names)}();" for _ in range(3))
    imports = "".join(f'import {{ x }} from "./m{rng.randrange(14)}";\n' for _ in range(2))
    return f"{imports}{rng.choice(['export ', ''])}function {rng.choice(names)}() {{ {calls} }}\nexport class C{i} extends C{rng.randrange(12)} {{ {rng.choice(names)}() {{ {calls} return new C{rng.randrange(12)}(); }} }}\n"


def rows(df, drop=()):
    return sorted(map(repr, df.drop(*drop).collect()))


def test_sync_equals_a_full_build(spark, tmp_path):
    rng = random.Random(3)
    names = [f"f{i}" for i in range(9)]
    tree = {f"src/m{i}.ts": source(i, rng, names) for i in range(12)}
    frame = lambda t: spark.createDataFrame([(p, x, "typescript") for p, x in t.items()], FILE)
    store = GraphStore(spark, str(tmp_path / "kept")).build(frame(tree))
    for step in range(3):
        old, before = store.edges(), None
        before = rows(old)
        changed = {f"src/m{i}.ts": source(i, rng, names) for i in rng.sample(range(12), 2)}
        gone = [] if step == 0 else [p for p in rng.sample(sorted(tree), 1) if p not in changed]
        if step:
            changed[f"src/m{12 + step}.ts"] = source(12 + step, rng, names)
        store.sync(frame(changed), spark.createDataFrame([(p,) for p in gone], "path string"))
        tree = {p: x for p, x in tree.items() if p not in gone} | changed
        whole = GraphStore(spark, str(tmp_path / f"whole{step}")).build(frame(tree))
        assert rows(store.table("nodes").select("id", "name", "file_path", "body_hash")) == rows(whole.table("nodes").select("id", "name", "file_path", "body_hash"))
        assert rows(store.table("bound")) == rows(whole.table("bound")) and rows(store.edges()) == rows(whole.edges())
        # a reader of the version before still sees that
        assert rows(old) == before
    # and what is written for one file is a part of the whole
    written = [spark.read.parquet(f).count() for f in store.now["folders"]["bound"]]
    assert max(written[1:]) < written[0] and len(written) == 4
    assert GraphStore(spark, str(tmp_path / "kept")).now["version"] == 3


def test_a_change_that_concerns_no_other_file_rewrites_its_own_rows_only(spark, tmp_path):
    tree = {f"m{i}.ts": f"export function f{i}() {{ g{i}(); }}\nfunction g{i}() {{}}\n" for i in range(30)}
    frame = lambda t: spark.createDataFrame([(p, x, "typescript") for p, x in t.items()], FILE)
    store = GraphStore(spark, str(tmp_path)).build(frame(tree))
    store.sync(frame({"m3.ts": "export function f3() { g3(); g3(); }\nfunction g3() { return 1; }\n"}))
    last = lambda t: spark.read.parquet(store.now["folders"][t][-1])
    assert {r["file_path"] for r in last("nodes").collect()} == {"m3.ts"} and last("bound").count() == 1 and last("refs").count() == 1
    assert store.table("bound").count() == 30
