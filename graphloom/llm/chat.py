"""Chat formatting with Spark expressions only.

Format of a conversation, for each run of adjacent turns of one role:

    <|im_start|>ROLE newline TEXT <|im_sep|> TEXT ... <|im_end|> newline

Texts and roles are escaped: a backslash becomes two, and "<|" becomes "<\\|",
so that control strings occur in the output only where the template puts them.
A newline in a role becomes <|nl|>. unescape() undoes this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END, NEWLINE = "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """One row per conv_id with turns: array of (turn, role, text), in order.

    Null role and text count as empty. Rows with equal turns are ordered by role
    and text; a null turn comes first. Repeated rows stay, each as a turn.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    return conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))


def let(value: Column, use) -> Column:
    """use(value), with value worked out once, also where use() needs it for each element of an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def merged_turns(turns: Column) -> Column:
    """Adjacent turns of one role become one (role, texts): places where the role changes, and what stands between them."""

    def runs(t: Column) -> Column:
        role = lambda i: F.get(t, i)["role"]
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (role(i) != role(i - 1)))

        def between(s: Column) -> Column:
            end = lambda k: F.coalesce(F.get(s, k + 1), F.size(t))
            texts = lambda x, k: F.transform(F.slice(t, x + 1, end(k) - x), lambda u: u["text"])
            return F.transform(s, lambda x, k: F.struct(role(x).alias("role"), texts(x, k).alias("texts")))

        return let(starts, between)

    return let(turns, runs)


#: Running sums and cuts are made in steps of this many, so that their work stays far below the square of an array's size.
STEP = 256


def running_sums(sizes: Column) -> Column:
    """For each element the sum of those before it; sizes: array of long, not empty."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

    def sums(n: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), ((F.size(n) - 1) / STEP).cast("int")), lambda k: total(F.slice(n, k * STEP + 1, STEP)))
        ahead = let(parts, lambda p: F.transform(p, lambda _, k: total(F.slice(p, F.lit(1), k))))
        step = lambda i: (i / STEP).cast("int")
        return let(ahead, lambda a: F.transform(n, lambda _, i: F.get(a, step(i)) + total(F.slice(n, step(i) * STEP + 1, i % STEP))))

    return let(sizes, sums)


def format_conversations(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, and loss_spans: array of (start, length) in code points.

    The loss mask covers the escaped texts of the roles given, without any
    control string. Other columns of the input, whatever their names, are
    ignored; no rows give no conversations. A conversation is one string, so
    that a single one must stay below Spark's 2 GB for a value; how many rows
    other conversations have does not matter.
    """
    runs = sorted_turns(conversations).select("conv_id", merged_turns(F.col("turns")).alias("runs"))

    def pieces(run: Column) -> Column:
        role = F.replace(escape(run["role"]), F.lit("\n"), F.lit(NEWLINE))
        head = F.struct(F.concat(F.lit(START), role, F.lit("\n")).alias("s"), F.lit(False).alias("loss"))
        loss = run["role"].isin(*loss_roles)
        bodies = F.flatten(
            F.transform(
                run["texts"],
                lambda t, i: F.array(
                    F.struct(F.when(i > 0, F.lit(SEP)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
                    F.struct(escape(t).alias("s"), loss.alias("loss")),
                ),
            )
        )
        return F.concat(F.array(head), bodies, F.array(F.struct(F.lit(END + "\n").alias("s"), F.lit(False).alias("loss"))))

    laid = runs.select("conv_id", F.flatten(F.transform("runs", pieces)).alias("pieces"))
    sizes = F.transform("pieces", lambda p: F.length(p["s"]).cast("long"))
    spans = let(running_sums(sizes), lambda at: F.transform("pieces", lambda p, i: F.struct(p["loss"].alias("loss"), F.get(at, i).alias("start"), F.length(p["s"]).cast("long").alias("length"))))
    return laid.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p["s"]), "").alias("formatted"),
        F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    blocks = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)

    def turns(block: Column) -> Column:
        body = F.regexp_replace(block, r"<\|im_end\|>\n$", "")
        cut = F.instr(body, "\n")
        role = unescape(F.replace(F.substring(body, F.lit(1), cut - 1), F.lit(NEWLINE), F.lit("\n")))
        texts = F.split(F.substring(body, cut + 1, F.length(body)), r"<\|im_sep\|>")
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between; spans in order. To find a place in a string takes time in proportion
    to the place, so that it is cut in parts of STEP spans first."""

    def read(spans: Column) -> Column:
        cut = lambda s, at, n: F.substring(s, (at + 1).cast("int"), n.cast("int"))

        def part(k: Column) -> Column:
            def told(own: Column) -> Column:
                first, last = F.get(own, F.lit(0)), F.element_at(own, -1)
                here = cut(formatted, first["start"], last["start"] + last["length"] - first["start"])
                return let(here, lambda x: F.array_join(F.transform(own, lambda s: unescape(cut(x, s["start"] - first["start"], s["length"]))), ""))

            return let(F.slice(spans, k * STEP + 1, STEP), told)

        return F.array_join(F.transform(F.sequence(F.lit(0), ((F.size(spans) - 1) / STEP).cast("int")), part), "")

    return F.when(F.size(loss_spans) == 0, F.lit("")).otherwise(let(loss_spans, read))


def chat_digest(conversations: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations, as counts and digests."""
    out = format_conversations(conversations)
    back = out.select(
        "conv_id",
        read_turns(F.col("formatted")).alias("turns"),
        read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
