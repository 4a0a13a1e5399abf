"""Sharding, chat formatting, mixing, WARC, decontamination and licences against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, decontaminate, licences, mixing, sharding, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 0) for i, t in enumerate(texts)], DOC)


# sharding


def test_lookup_table():
    owner = sharding.lookup_table([f"s{i}" for i in range(7)], 1009)
    sizes = [owner.count(i) for i in range(7)]
    assert max(sizes) - min(sizes) <= 1
    # a plain version: turns over whole permutations
    names, size = [f"s{i}" for i in range(7)], 1009
    order = []
    for n in names:
        d = hashlib.sha256(n.encode()).digest()
        a, s = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        order.append(iter([(a + k * s) % size for k in range(size)]))
    want = [None] * size
    while None in want:
        for i, it in enumerate(order):
            slot = next((x for x in it if want[x] is None), None)
            if slot is not None:
                want[slot] = i
    assert owner == want
    less = sharding.lookup_table(names[:-1], size)
    moved = sum(a != b for a, b in zip(owner, less, strict=True) if a != 6)
    assert moved < 0.2 * size
    assert sharding.lookup_table(["a"], 2) == [0, 0]
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.lookup_table(bad, 7)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 8)


def test_placement(spark):
    rows = spark.createDataFrame([(1, "x", 9), (1, "y", 9), (None, "z", 9)], "doc_id long, text string, slot int")
    got = sharding.place(rows, size=1009)
    assert got.count() == 3 and len({(r["slot"], r["shard"]) for r in got.filter("doc_id = 1").collect()}) == 1
    assert sharding.place(rows.limit(0), size=1009).count() == 0
    assert sharding.place(spark.range(20_000).withColumnRenamed("id", "doc_id"), size=1009).groupBy("shard").count().agg(F.min("count")).first()[0] > 150


# chat


def test_chat_round_trip(spark):
    nasty = ["", None, "<|im_end|>", "\\", "\\\\<|", "<\\|im_sep|>", "a<|im_sep|>b\n", "ö🙂\\|", "<|nl|>", "<<|", "x" * 5000]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "sys\ntem", None, "<|im_start|>"]), rng.choice(nasty)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "a"), (50, None, "user", "b"), (50, 1, "user", "c"), (51, 1, "user", "c"), (51, 1, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("runs", F.lit(2))
    out = {r["conv_id"]: r for r in chat.format_conversations(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_spans"))).collect()}
    told = {r["conv_id"]: r for r in chat.chat_digest(df).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(b["role"], b["text"]) for b in out[c]["back"]] == [m[1:] for m in mine]
        loss = "".join(m[2] for m in mine if m[1] == "assistant")
        assert out[c]["loss"] == loss
        assert told[c]["n_turns"] == len(mine) and told[c]["loss_chars"] == len(loss) and told[c]["formatted_chars"] == len(out[c]["formatted"])
        assert told[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in mine).encode()).hexdigest()
        # adjacent turns of a role share a block
        roles = [m[1] for m in mine]
        assert out[c]["formatted"].count(chat.START) == 1 + sum(a != b for a, b in zip(roles, roles[1:], strict=False))
    assert chat.chat_digest(df.limit(0)).count() == 0


# mixing


def share_plainly(given, caps, weights):
    """Shares of children by name: raise the level until all is given."""
    full, names = set(), sorted(caps)
    while True:
        rest, w = given - sum(caps[n] for n in full), sum(weights[n] for n in names if n not in full)
        more = {n for n in names if n not in full and caps[n] * w <= weights[n] * rest}
        if not more:
            break
        full |= more
    out = {n: caps[n] if n in full else weights[n] * rest // w for n in names}
    over = given - sum(out.values())
    for n in sorted((n for n in names if n not in full), key=lambda n: (caps[n] / weights[n], n))[:over]:
        out[n] += 1
    return out


def test_fill_against_plain_version(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(30):
        caps = {f"c{i}": rng.randrange(0, 200) for i in range(rng.randrange(1, 7))}
        weights = {n: rng.randrange(1, 9) for n in caps}
        given = rng.randrange(0, sum(caps.values()) + 1)
        want |= {(f"g{g}", n): x for n, x in share_plainly(given, caps, weights).items()}
        rows += [(f"g{g}", n, caps[n], weights[n], given) for n in caps]
    df = spark.createDataFrame(rows, "g string, name string, cap long, weight long, given long")
    assert {(r["g"], r["name"]): r["share"] for r in mixing.fill(df, ["g"], "name").collect()} == want


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 30)) if i % 17 else None, rng.choice(["en", "de", None]), f"src{rng.randrange(4)}", 0) for i in range(400)]
    df = spark.createDataFrame(rows, DOC).withColumn("quota", F.lit(1)).withColumn("epoch", F.lit(1))
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    for per_mille in (300, 1500, 5000):
        got = mixing.mix(df, levels, ({"en": 5}, {"src1": 3}), per_mille, max_epochs=2).collect()
        total = sum(len((r[1] or "").split()) for r in rows)
        assert sum(r["taken"] for r in got) == min(total * per_mille // 1000, 2 * total)
        assert all(0 < r["taken"] <= r["n_tokens"] and r["epoch"] < 2 for r in got)
        leaf = {}
        for r in got:
            leaf.setdefault((r["lang"], r["source"], r["quota"]), []).append(r)
        for (_, _, quota), part in leaf.items():
            assert sum(r["taken"] for r in part) == quota
            assert sum(r["taken"] < r["n_tokens"] for r in part) <= 1
            first = {r["doc_id"] for r in part if r["epoch"] == 0}
            assert {r["doc_id"] for r in part if r["epoch"] == 1} <= first
        assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(df.repartition(7), levels, ({"en": 5}, {"src1": 3}), per_mille, max_epochs=2).collect()))
    assert mixing.mix(df.limit(0), levels, ({}, {})).count() == 0


# WARC


def test_canonical_url(spark):
    urls = {
        "http://WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#top": "example.com/a/b?a=1&b=2", "https://example.com": "example.com", "https://example.com/": "example.com",
        "example.com/x?": "example.com/x", "ftp://www2.h.org:8080/A//": "h.org:8080/A", "": "", None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string").select("url", warc.canonical_url(F.col("url")).alias("c"))
    assert {r["url"]: r["c"] for r in df.collect()} == urls


def test_revisits_against_plain_version(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        url = rng.choice(["http://hot.org/x"] * 6 + [f"http://h{rng.randrange(30)}.org/", None])
        kind = rng.choice(["response", "revisit", "revisit", None])
        tag = rng.choice(["a", "b", 'W/a', None])
        heads = {"ETag": "e%d" % i, "Content-Length": "5", "date": str(i), "Vary": "v"} if rng.random() < 0.8 else None
        rows.append((i, url, rng.choice([rng.randrange(80), None]) if i % 9 == 0 else rng.randrange(80), kind, tag, rng.choice(["m1", "m2", None]), rng.choice(["d1", "d2", None]), i, heads, "x"))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, warc.RECORD + ", key string")
    got = sorted((r["record_id"], r["base_id"], r["verdict"], r["digest"], r["n_bytes"], None if r["headers"] is None else tuple(sorted(r["headers"].items()))) for r in warc.resolve_revisits(df).collect())
    got = sorted(got, key=repr)
    want = []
    for i, url, at, kind, tag, lm, digest, n, heads, _ in rows:
        if kind != "revisit":
            continue
        base = [r for r in rows if r[3] == "response" and url is not None and r[1] == url and at is not None and r[2] is not None and r[2] < at]
        b = max(base, key=lambda r: (r[2], r[0])) if base else None
        weak = lambda t: t and t.removeprefix("W/")
        if b is None:
            v = "no_base"
        elif tag or lm or digest:
            ok = weak(tag) == weak(b[4]) if tag else lm == b[5] if lm else digest == b[6]
            v = "resolved" if ok else "mismatch"
        else:
            v = "unverified"
        merged = None
        if v == "resolved":
            old, new = {k.lower(): x for k, x in (b[8] or {}).items()}, {k.lower(): x for k, x in (heads or {}).items()}
            merged = tuple(sorted((old | {k: x for k, x in new.items() if k in warc.PERMITTED}).items()))
        want.append((i, b and b[0], v, b[6] if v == "resolved" else None, b[7] if v == "resolved" else None, merged))
    assert got == sorted(want, key=repr)
    assert warc.resolve_revisits(df.limit(0)).count() == 0
    pages = spark.createDataFrame([(0, "http://a/", "<p>"), (1, None, None), (2, "http://a", "<p>")], "page_id long, url string, html string")
    assert {r["record_id"]: r["verdict"] for r in warc.resolve_revisits(warc.capture_records(pages)).collect()} == {0: "no_base", 2: "resolved", 3: "no_base", 5: "no_base", 6: "resolved", 8: "resolved"}


# decontamination


def test_decontamination_against_plain_version(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(60)] + ["É", "é", "Ünï"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [say(rng.choice([3, 12, 13, 14, 30])) for _ in range(12)] + [["aa"], []]
    items.append(list(items[0]))
    texts = []
    for _ in range(150):
        t = say(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            it = rng.choice(items)
            at = rng.randrange(len(t) + 1)
            t[at:at] = it[rng.randrange(2) :]
        texts.append(rng.choice([" ", ", ", "\n"]).join(w.upper() if w.isascii() else w for w in t))
    texts += [None, "", " .,", "AA", "x" * 100_000, texts[3], texts[3]]
    bench = spark.createDataFrame([(i, " - ".join(w)) for i, w in enumerate(items)] + [(99, None)], "item_id long, text string")
    d = docs(spark, texts).withColumn("w", F.lit(1)).withColumn("items", F.lit(2)).withColumn("anchor", F.lit(3))
    grams = {}
    for i, w in enumerate(items):
        w = [low(x) for x in w]
        for k in range(max(1, len(w) - 12)):
            if w:
                grams.setdefault(tuple(w[k : k + 13]), set()).add(str(i))
    got = {r["doc_id"]: r for r in decontaminate.digest(d, bench).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = WORD.findall(low(t))
        hit, ids = set(), set()
        for k in range(len(w)):
            for n in {len(g) for g in grams}:
                if g := grams.get(tuple(w[k : k + n])) if k + n <= len(w) else None:
                    hit |= set(range(k, k + n))
                    ids |= g
        r = got[i]
        want = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want, i
    kept = {r["doc_id"] for r in decontaminate.remove_documents(d, bench).collect()}
    assert kept == {i for i in got if not got[i]["contaminated"]}
    clean = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(d, bench).collect()}
    for i, t in enumerate(texts):
        assert len(WORD.findall(low(clean[i]))) == got[i]["n_words"] - got[i]["n_hit"]
        assert got[i]["n_hit"] or clean[i] == t
    assert decontaminate.digest(d.limit(0), bench).count() == 0
    assert {r["n_hit"] for r in decontaminate.digest(d, bench.limit(0)).collect()} == {0}
    # beyond the bound the windows are not broadcast, and the result is the same
    old, decontaminate.BROADCAST_BYTES = decontaminate.BROADCAST_BYTES, -1
    try:
        assert sorted(map(tuple, decontaminate.digest(d, bench).collect())) == sorted(map(tuple, got.values()))
    finally:
        decontaminate.BROADCAST_BYTES = old


def test_decontamination_of_repeated_and_null_ids(spark):
    item = " ".join(f"b{i}" for i in range(13))
    dirty = item + " " + " ".join(f"c{i}" for i in range(150))
    clean = [" ".join(f"d{k}x{i}" for i in range(200)) for k in range(3)]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    rows = [(1, dirty), (1, dirty), (1, dirty), (2, dirty), (2, clean[0]), (None, dirty), (None, clean[1]), (None, clean[2]), (None, None), (3, clean[0])]
    d = spark.createDataFrame([(i, t, "en", "s", k) for k, (i, t) in enumerate(rows)], DOC)
    got = decontaminate.report(d, bench).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["contaminated"]) for r in got) == sorted((str(i), len((t or "").split()), 13 * (t == dirty), t == dirty) for i, t in rows)
    assert {r["n_chars"] for r in decontaminate.remove_documents(d, bench).collect()} == {k for k, (_, t) in enumerate(rows) if t != dirty}
    cut = {r["n_chars"]: r["text"] for r in decontaminate.remove_spans(d, bench).collect()}
    assert cut == {k: t.removeprefix(item + " ") if t == dirty else t for k, (_, t) in enumerate(rows)}


# licences


def plain_best(w, x):
    """The largest containment of a template in a span of words that meets it, else 0."""
    t = licences.plain_words(x.text)
    span, need, best = len(t) * 3 // 2, licences.need_of(len(set(t))), 0
    for i in range(len(w)):
        if w[i] in t:
            s = set(w[i : i + span])
            named = {w[k] for k in range(i, min(i + span, len(w))) if not {*w[max(0, k - 1) : k], *w[k + 1 : k + 2]} & set(x.bar)}
            if len(s & set(t)) >= need and named >= set(x.must):
                best = max(best, len(s & set(t)) / len(set(t)))
    return best


def test_licences_against_plain_version(spark):
    rng = random.Random(8)
    notices = [t.text for t in licences.TEMPLATES]
    texts = [None, "", "MIT License and mit-license, CC\nBY", "Licensed under CC BY-NC 4.0.", "x" * 50_000]
    for _ in range(120):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            w = rng.choice(notices).split()
            keep = rng.choice([1, 0.95, 0.85, 0.7])
            w = [x for x in w if rng.random() < keep] + ["foo"] * rng.randrange(3)
            if rng.random() < 0.3:
                rng.shuffle(w)
            lines.append(rng.choice([" ", "\n# ", "\n// "]).join(w).upper() if rng.random() < 0.3 else " ".join(w))
            lines += ["bar " * rng.randrange(150)]
        texts.append("\n".join(lines))
    d = docs(spark, texts + [texts[9]]).withColumn("t", F.lit(1)).withColumn("label", F.lit("x")).withColumn("block", F.lit("x"))
    got = {r["doc_id"]: r for r in licences.scan(d).collect()}
    found = set()
    for i, t in enumerate(texts + [texts[9]]):
        w = WORD.findall(low(t))
        base = sorted((k, label) for p, label in licences.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        best = {x.label: plain_best(w, x) for x in licences.TEMPLATES}
        labels = {x for _, x in base} | {k for k, v in best.items() if v}
        found |= labels
        score = 1.0 if base else max(best.values())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None)
        assert (r["base_labels"], r["labels"]) == (",".join(sorted({x for _, x in base})), ",".join(sorted(labels))) and abs(r["score"] - score) < 1e-12
    assert found == {x.label for x in licences.TEMPLATES} | {x for _, x in licences.PHRASES}
    assert licences.scan(d.limit(0)).count() == 0
    twice = licences.scan(d.unionByName(d.filter("doc_id = 9")).unionByName(d.filter("doc_id in (7, 9)").withColumn("doc_id", F.lit(None).cast("long")))).collect()
    # a row for each row
    assert [r["labels"] for r in twice if r["doc_id"] == 9] == [got[9]["labels"]] * 2 and len(twice) == len(got) + 3
    assert sorted(r["n_words"] for r in twice if r["doc_id"] is None) == sorted(got[i]["n_words"] for i in (7, 9))


def test_neighbouring_notices_of_siblings(spark):
    both = {"notice:cc-by-4.0", "notice:cc-by-sa-4.0"}
    pairs = {
        "Licensed under CC BY 4.0 / CC BY-SA 4.0": both, "Licensed under CC BY-SA 4.0, or licensed under CC BY 4.0": both, "Licensed under CC BY-SA 4.0. Licensed under CC BY-SA 4.0": {"notice:cc-by-sa-4.0"},
        "by-nc-sa 4.0 Licensed under CC BY-NC-SA 4.0": set(), "x " * 20 + "nc sa 4.0 Licensed under CC BY": {"notice:cc-by-4.0"}, "Licensed under CC BY 4.0 " * 9 + "ND": {"notice:cc-by-4.0"},
    }
    got = {r["doc_id"]: {x for x in r["labels"].split(",") if x.startswith("notice:")} for r in licences.scan(docs(spark, list(pairs))).collect()}
    assert [got[i] for i in range(len(pairs))] == list(pairs.values())


def test_notices_are_found_as_files_hold_them_and_siblings_told_apart(spark):
    by = {t.label: t for t in licences.TEMPLATES}
    wrapped = lambda label, n, mark: "\n".join(mark + " ".join(by[label].text.split()[i : i + n]) for i in range(0, len(by[label].text.split()), n))
    texts = ["code = 1\n" * 90 + wrapped("notice:mit-text", 7, " * ") + "\nint x;" * 200, wrapped("notice:gpl-text", 9, "// "), wrapped("notice:lgpl-text", 5, "# "), "a " * 1000 + wrapped("notice:bsd-text", 500, "")]
    texts += [t.text for t in licences.TEMPLATES] + ["Released under the BSD License", "the License was released. " * 20 + "MIT is not where the sea lies under", "Licensed under CC BY-NC-SA 4.0"]
    got = {r["doc_id"]: {x for x in r["labels"].split(",") if x.startswith("notice:")} for r in licences.scan(docs(spark, texts)).collect()}
    assert [got[i] for i in range(4)] == [{"notice:mit-text"}, {"notice:gpl-text"}, {"notice:lgpl-text"}, {"notice:bsd-text"}]
    for i, t in enumerate(licences.TEMPLATES):
        # the text of the Apache licence begins with the line that is a template of its own
        assert got[4 + i] == {t.label} | ({"notice:apache-2.0"} if t.label == "notice:apache-text" else set())
    assert got[len(texts) - 3] == got[len(texts) - 2] == got[len(texts) - 1] == set()


def test_each_filter_drops_something(spark):
    rng = random.Random(18)
    words = [w for t in licences.TEMPLATES for w in licences.plain_words(t.text)]
    d = docs(spark, [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 300))) for _ in range(200)]).select("doc_id", "text")
    order = licences.ordered_templates(licences.read(d))
    least = min(x["need"] for x in order)
    w = licences.words_of(F.col("text"))
    blocks = d.select(F.explode(licences.probes(w, order)).alias("x")).select("x.*")
    assert blocks.filter(F.size("b") < least).isEmpty() and not blocks.filter(F.col("q") > F.size("b") - least).count()
    pairs = blocks.join(licences.prefixes(d, order), "word")
    short, late = pairs.filter(F.size("b") < F.col("need")).count(), pairs.filter((F.size("b") >= F.col("need")) & (F.size("b") - F.col("q") < F.col("need"))).count()
    kept = pairs.filter(licences.filtered(F.col("b"), F.col("q"))).count()
    assert short > 0 and late > 0 and kept > 0 and short + late + kept == pairs.count()
    # and the prefixes leave most words of blocks and templates out
    assert sum(len(x["t"]) - x["need"] + 1 for x in order) < 0.4 * sum(len(x["t"]) for x in order)


def test_a_conversation_of_very_many_turns(spark):
    import time

    n = 100_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t<|"), F.col("id")).alias("text"))
    began = time.time()
    got = chat.chat_digest(rows).collect()[0]
    assert time.time() - began < 60
    assert got["n_turns"] == n and got["loss_sha256"] == hashlib.sha256("".join(f"t<|{i}" for i in range(n) if i % 3).encode()).hexdigest()


def test_placement_against_plain_version(spark):
    import xxhash

    owner = sharding.lookup_table(sharding.SHARDS, 1009)
    for r in sharding.place(spark.range(-50, 500).withColumnRenamed("id", "doc_id"), size=1009).collect():
        h = xxhash.xxh64_intdigest(str(r["doc_id"]).encode(), seed=42)
        slot = (h - (1 << 64) if h >> 63 else h) % 1009
        assert (r["slot"], r["shard"]) == (slot, sharding.SHARDS[owner[slot]])


def test_lines_are_counted_by_documents(spark):
    from graphloom.llm import line_rules

    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(1, "same footer\n" + body(0))] * 12 + [(i, "seldom seen\n" + body(i)) for i in range(2, 8)] + [(i, "often seen\n" + body(i)) for i in range(20, 31)] + [(None, "no name\n" + body(99))] * 10
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC)
    got = {(r["doc_id"], r["text"].split("\n")[0] if "text" in r else None, r["n_removed"]) for r in line_rules.line_rules(df).withColumn("text", F.lit("\n")).collect()}
    by = {(i, n) for i, _, n in got}
    # the rows of document 1 are one document; each row without a doc_id is one
    assert {(1, 0), (2, 0), (20, 2)} <= by and any(i is None and n > 0 for i, n in by)
    hot = spark.createDataFrame([(i, ("a passage of the host\n" if i < 120 else "") + body(i), "en", "s", 0) for i in range(15_000)], DOC)
    assert line_rules.line_rules(hot).filter("n_removed > 0").count() == 120
