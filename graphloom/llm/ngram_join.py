"""Exact self-join of documents on the Jaccard similarity of their five-word shingles.

The method is a parity-sketch join. A set's sketch has a bit for each of a great
many places; every shingle toggles one. Toggling twice cancels, so that the Hamming
distance of two sketches is at most the size of the symmetric difference of the
sets. Sets with similarity t or more differ in at most D = (1 - t) / (1 + t) *
(a + b) shingles, a and b being their sizes. The places are dealt to k > D blocks, so
at most D blocks differ, and of any D + 1 blocks one is equal.

- Size bands: band l holds sizes from 2**l to 2**(l + 1) - 1 and has its own k. A set
  is put into its own band, and into the next one if a partner may be there.
- Each set gives its first D + 1 + SLACK blocks with a bit set, where D is the largest
  that any partner allows. Of two similar sets, take the one whose last such block
  comes first: at most D of its blocks differ, so SLACK + 1 are equal, and the other set
  gives these blocks too. Blocks are kept as the XOR of the shingles' 64-bit hashes.
- Shingles in a large share of all documents are left out of the sketches, which
  keeps the bound, since the rest of two sets differs no more than the sets. Any
  set of shingles may be left out; the result is the same. Sets with too few
  blocks after that are weak. Two similar sets are found as above unless both are
  weak; for this, weak sets also give blocks of their whole sets, kept apart.
- Documents with equal sets form a class first; only classes are compared.
- Many sets may give one block. Up to SMALL of them are paired with each other; in
  a large block the others are paired with one of them. These pairs are verified.
- A pair that is missed by this has only large blocks in common, SLACK + 1 of them or
  more. The few sets with so many large blocks give blocks once more, the large
  ones last, so that a passage that many share is in few sets' first D + 1 + SLACK blocks.
  The order of the blocks may be any, if it is the same for all sets. Of blocks that
  are in different components, small ones give pairs; large ones are compared by
  dense sketches, in squares of CHUNK by CHUNK, but for the SLACK largest of each set:
  the smallest of the blocks that a missed pair has in common comes after these in the
  order of size, which is the same for all sets. Of the pairs that may be linked a
  spanning forest, the closest first, is verified, at first with each set in its
  largest block only; then all that may still join two components, which were
  verified at once where they were no more than the members of a square.
- Pairs that pass the bound on dense sketches are verified with the shingles.

Components are found by alternating large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh, ship, spread, told, untold

ship(__name__)

WORDS = 5
#: Similarity in per cent from which on documents are linked.
PER_CENT = 75
#: Sets that give the same block: up to this many are all paired with each other at once.
SMALL = 8
#: Of a block that more than so many sets of one slice of text give, one of these sets stands for all.
HOT = 32
#: Blocks that a set gives besides the D + 1 that it must; at most 7.
SLACK = 4
#: Members of a larger block are compared in squares of this many.
CHUNK = 4096
#: Block entries, and members of squares, handled together.
GROUP_KEYS = 1 << 20
HANDFUL = 1 << 14
#: A shingle is common when about 1 in COMMON documents holds it.
COMMON = 256
#: At most so many common shingles are left out of the sketches, the most common first.
MOST_COMMON = 1 << 20
#: Edges up to this number are broadcast in the rounds that find components (16 bytes each); beyond it they are shuffled.
BROADCAST_EDGES = 500_000
#: So many of them are for one task, which joins what they join; the rounds join what the tasks found.
TASK_EDGES = 50_000
#: A set of numbers is broadcast as a bit set of about 16 bits each and of at most so many 64-bit words, 64 MB. Beyond that more
#: numbers pass for members than are; what uses the sets gives the same result for any superset.
BIT_WORDS = 1 << 23
#: Dense sketches have at least so many halves of a bit for each shingle, up to so many bits: those of all sets, and sharper
#: ones of the few sets that are compared in squares.
DENSE, SHARP = (3, 1 << 15), (8, 1 << 17)

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * _Q
    x = (x ^ (x >> np.uint64(29))) * _P
    return x ^ (x >> np.uint64(32))


#: Text is hashed in slices of about this many bytes; a longer text is a slice of its own.
SLICE = 2 << 20
_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_Q_INVERSE = np.uint64(pow(int(_Q), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base to the power of 0 to n - 1, modulo 2 ** 64."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of raw, A-Z as a-z.

    The hash is a polynomial over the word's bytes, got from running sums over
    the whole text, and mixed with the word's length.
    """
    b = np.frombuffer(raw, dtype=np.uint8)
    solid = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(np.r_[False, solid, False]))
    start, end = edge[::2], edge[1::2]
    total = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * powers(_Q, len(b)), out=total[1:])
    h = (total[end] - total[start]) * powers(_Q_INVERSE, len(b) + 1)[start]
    return start, mix(h + (end - start).astype(np.uint64) * _P)


def slices(texts: Iterator[str | None]) -> Iterator[list[bytes]]:
    """Texts as bytes, in lists of about SLICE bytes; null is empty."""
    out, size = [], 0
    for t in texts:
        raw = b"" if t is None else t.encode("utf-8", "surrogatepass")
        if out and size + len(raw) > SLICE:
            yield out
            out, size = [], 0
        out.append(raw)
        size += len(raw) + 1
    if out:
        yield out


def shingles(raws: list[bytes]) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer than five words are one shingle, none none."""
    start, w = word_hashes(b"\n".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    first = np.searchsorted(start, np.r_[0, ends])
    s = np.empty(0, dtype=np.uint64)
    if len(w) >= WORDS:
        n = len(w) - WORDS + 1
        s = w[:n].copy()
        for k in range(1, WORDS):
            s = s * _P + w[k : n + k]
        s = mix(s)
    out = []
    for a, z in zip(first[:-1], first[1:], strict=True):
        if z - a >= WORDS:
            x = np.sort(s[a : z - WORDS + 1])
            out.append(x[np.r_[True, x[1:] != x[:-1]]])
        elif z > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(w[a:z].tobytes(), seed=1)], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def class_id(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit numbers that name a set."""
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def dense_sketch(s: np.ndarray, fine: tuple[int, int] = DENSE) -> bytes:
    """Parity bits of a set, 256 at least."""
    bits = min(fine[1], max(256, 1 << (fine[0] * len(s) // 2).bit_length()))
    at = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((at & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """The sketch that the set would have with fewer bytes: parities of places that fall together."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def max_difference(a, b):
    """Shingles in which sets of these sizes can differ and still be linked."""
    return (100 - PER_CENT) * (a + b) // (100 + PER_CENT)


# sets of numbers as bits


def _bits_of(x: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word and two bits of each number."""
    x = mix(x.view(np.uint64) ^ _P)
    one = np.uint64(1)
    return (x % np.uint64(words)).astype(np.int64), (one << (x >> np.uint64(40) & np.uint64(63))) | (one << (x >> np.uint64(50) & np.uint64(63)))


def bit_set(numbers: DataFrame):
    """A broadcast bit set of a column of longs: all of these are members, of other numbers a few per cent, see BIT_WORDS."""
    words = 1 << 8
    n = numbers.agg(F.approx_count_distinct(numbers.columns[0])).first()[0]
    while words < BIT_WORDS and words * 4 < n:
        words *= 2

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            word, bits = _bits_of(pdf.iloc[:, 0].to_numpy(dtype=np.int64), words)
            order = np.argsort(word, kind="stable")
            word, bits = word[order], bits[order]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else word
            both = np.bitwise_or.reduceat(bits, first) if len(word) else bits
            yield pd.DataFrame({"word": word[first].astype(np.int32), "bits": both.view(np.int64)})

    marked = numbers.mapInPandas(mark, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(words, dtype=np.uint64)
    out[marked["word"].to_numpy()] = marked["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return numbers.sparkSession.sparkContext.broadcast(out)


def members(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    word, both = _bits_of(x, len(bits))
    return (bits[word] & both) == both


# blocks

#: Blocks for each place of a band's top size, in hundredths: enough that hardly any set has too few with a bit
#: set, and few enough that a block is seldom made of a shared passage alone. Smaller sizes have SPARSE blocks.
DENSITY = {5: 75, 6: 60, 7: 50, 8: 45, 9: 40}
SPARSE = 1024


def layout_blocks(layout: np.ndarray) -> np.ndarray:
    """k of a band: always more than the shingles in which a pair of it can differ."""
    top = np.left_shift(np.int64(2), layout)
    share = np.array([DENSITY.get(e, 34) for e in range(64)])[layout + 1]
    return np.where(top <= 16, SPARSE, top * share // 100 + 1)


def layouts(n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Own and next band: (which of n, band, blocks that each has to give)."""
    band = np.floor(np.log2(n)).astype(np.int64)
    top = np.left_shift(np.int64(2), band)
    largest = n * 100 // PER_CENT
    own = max_difference(n, np.minimum(largest, top - 1)) + 1
    over = np.flatnonzero(largest >= top)
    return [(np.arange(len(n)), band, own), (over, band[over] + 1, max_difference(n[over], largest[over]) + 1)]


def blocks(sets: list[np.ndarray], n: np.ndarray, tag: int, groups: int, late: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners and slack of the blocks that the sets give, and which sets gave too few.

    n: sizes of the whole sets, of which sets may be parts. late: a bit set of the names of blocks that come last.
    The slack of a set is how many blocks it gives beyond those that it must; one that gives all it has counts as
    having SLACK, since it limits no other set.
    """
    none = np.empty(0, dtype=np.int64)
    keys, owners, slacks, weak = [none.view(np.uint64)], [none], [none], np.zeros(len(sets), dtype=bool)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if len(sets) else none.view(np.uint64)
    start = np.concatenate([[0], np.cumsum(size)])
    for which, band, need in layouts(n):
        if not len(which):
            continue
        k = layout_blocks(band)
        take = np.concatenate([np.arange(start[i], start[i + 1]) for i in which])
        row = np.repeat(np.arange(len(which)), size[which])
        s = flat[take]
        block = (s >> np.uint64(24)).astype(np.int64) % k[row]
        place = row * np.int64(1 << 32) + block
        order = np.argsort(place, kind="stable")
        place, s = place[order], s[order]
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]]) if len(place) else none
        value = np.bitwise_xor.reduceat(s, first) if len(first) else none.view(np.uint64)
        place = place[first]
        place, value = place[value != 0], value[value != 0]
        owner = place >> 32
        at = (place & np.int64(0xFFFFFFFF)) * 256 + band[owner] * 4 + tag
        key = mix(value ^ mix(at.astype(np.uint64) + np.uint64(1)))
        if late is not None:
            order = np.lexsort((place, members(late, block_name(key, groups)), owner))
            owner, key = owner[order], key[order]
        given = np.bincount(owner, minlength=len(which))
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(given) - given, given)
        few = given < need
        weak[which[few]] = True
        slack = np.where(few, SLACK, np.minimum(SLACK, given - need))
        use = rank < need[owner] + SLACK
        keys.append(key[use])
        owners.append(which[owner[use]])
        slacks.append(slack[owner[use]])
        if tag and few.any():
            # hardly any set gives too few even here; these are all compared with each other
            alone = band[few] * 4 + 2
            keys.append(mix(alone.astype(np.uint64) + np.uint64(1 << 60)))
            owners.append(which[few])
            slacks.append(np.zeros(few.sum(), dtype=np.int64))
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(slacks), weak


def block_group(keys: np.ndarray, groups: int) -> np.ndarray:
    return (keys >> np.uint64(32)) % np.uint64(groups)


def block_name(keys: np.ndarray, groups: int) -> np.ndarray:
    """What is kept of a key: its group and lower half."""
    return ((block_group(keys, groups) << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))).view(np.int64)


def tokens_of(whole: list[np.ndarray], groups: int, left_out: np.ndarray, late: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, owners and slack of all blocks that sets give, those of whole sets for weak ones included."""
    n = np.array([len(s) for s in whole], dtype=np.int64)
    parts = whole
    if len(left_out):
        flat = np.concatenate(whole)
        rare = left_out[np.minimum(np.searchsorted(left_out, flat), len(left_out) - 1)] != flat
        parts = [s[r] for s, r in zip(whole, np.split(rare, np.cumsum(n)[:-1]), strict=True)]
    keys, owners, slack, weak = blocks(parts, n, 0, groups, late)
    if weak.any():
        some = np.flatnonzero(weak)
        k, o, r, _ = blocks([whole[i] for i in some], n[some], 1, groups, late)
        keys, owners, slack = np.r_[keys, k], np.r_[owners, some[o]], np.r_[slack, r]
    return keys, owners, slack


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document, and rows for shingles that many documents of a slice hold (doc null, d1 shingle, n count)."""
    for pdf in batches:
        ids = iter(pdf["doc_id"])
        for raws in slices(pdf["text"]):
            rows, sets = [], {}
            for s in shingles(raws):
                d1, d2 = class_id(s) if len(s) else (0, 0)
                rows.append((True, len(s), d1, d2, dense_sketch(s) if len(s) else b""))
                if len(s):
                    sets[d1, d2] = s
            df = pd.DataFrame(rows, columns=["doc", "n", "d1", "d2", "sketch"])
            df.insert(0, "doc_id", pd.array(list(islice(ids, len(raws))), dtype=object))
            yield df
            if sets:
                h = np.sort(np.concatenate(list(sets.values())))
                least = max(4, len(sets) // COMMON)
                # in sorted order a shingle that occurs that often is equal to the one so many places on
                h = h[: max(0, len(h) - least + 1)][h[: max(0, len(h) - least + 1)] == h[least - 1 :]]
                h, k = np.unique(h, return_counts=True)
                none = pd.array([None] * len(h), dtype=object)
                yield pd.DataFrame({"doc_id": none, "doc": False, "n": k + (least - 1), "d1": h.view(np.int64), "d2": 0, "sketch": b""})


#: Kinds of what comes of blocks: a pair of classes; a class, its large blocks (times 8) and their least slack; the name of a large block.
PAIR, LARGE, NAME = 0, 1, 2
#: Marks the slack of a class that stands for more than HOT of its slice.
STANDS = 128


def runs(key: np.ndarray, cls: np.ndarray, slack: np.ndarray):
    """Entries in order of key and class, once each: first of each key, key of each, key, cls, slack (with STANDS) by key."""
    order = np.lexsort((cls, key))
    key, cls, slack = key[order], cls[order], slack[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
    least = np.minimum.reduceat(slack & 7, first) if len(first) else slack
    stands = np.bitwise_or.reduceat(slack & STANDS, first) if len(first) else slack
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    of = (np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if len(key) else np.empty(0, dtype=np.int64))[new]
    key, cls = key[new], cls[new]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else of
    return first, of, key, cls, least, stands


def large_counts(cls: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes, and the number of their large blocks times 8 with the least slack."""
    if not len(cls):
        return cls, cls
    order = np.argsort(cls, kind="stable")
    c, at, k = np.unique(cls[order], return_index=True, return_counts=True)
    return c, k * 8 + np.minimum.reduceat(least[order], at)


def _pack(groups: int, common):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left_out = common.value
        for pdf in batches:
            for raws in slices(pdf["text"]):
                sets = {class_id(s)[0]: s for s in shingles(raws) if len(s)}
                if sets:
                    yield _packed(sets, groups, left_out)

    return pack


def _packed(sets: dict[int, np.ndarray], groups: int, left_out: np.ndarray) -> pd.DataFrame:
    """Block keys of sets, a row for each group of keys.

    Of a block that more than HOT of these sets give, one class stands for all: the others are told of in a row of
    a group below 0, so that a block that a large part of all sets gives comes as a few entries from each slice. They
    are told of with no slack, since other slices may have sets with less.
    """
    ids = np.fromiter(sets, dtype=np.int64, count=len(sets))
    keys, owners, slack = tokens_of(list(sets.values()), groups, left_out)
    first, of, keys, cls, least, _ = runs(keys, ids[owners], slack)
    size = np.diff(np.r_[first, len(keys)])
    large = size[of] > HOT
    other = large & (np.arange(len(of)) != first[of])
    slack = np.where(large, least[of] | STANDS, least[of])
    told = large_counts(cls[other], np.zeros(other.sum(), dtype=np.int64))
    pairs = np.unique(np.stack([cls[first[of[other]]], cls[other]]), axis=1)
    keys, cls, slack = keys[~other], cls[~other], slack[~other]
    group = block_group(keys, groups)
    order = np.argsort(group, kind="stable")
    group, keys, cls, slack = group[order], keys[order], cls[order], slack[order]
    cut = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    out = {
        "p": group[cut].astype(np.int32),
        "keys": [x.astype(np.uint32).tobytes() for x in np.split(keys, cut[1:])],
        "ids": [x.tobytes() for x in np.split(cls, cut[1:])],
        "slack": [x.astype(np.uint8).tobytes() for x in np.split(slack, cut[1:])],
    }
    if len(told[0]):
        # kinds in slack
        aside = pd.DataFrame({
            "p": np.int32(-1 - int(ids[0] % groups)),
            "keys": [np.r_[pairs[0], told[0]].tobytes()],
            "ids": [np.r_[pairs[1], told[1]].tobytes()],
            "slack": [np.repeat(np.array([PAIR, LARGE], dtype=np.uint8), [pairs.shape[1], len(told[0])]).tobytes()],
        })
        return pd.concat([pd.DataFrame(out), aside], ignore_index=True)
    return pd.DataFrame(out)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """What comes of one group of keys: kind, a, b."""
    p = int(pdf["p"].iat[0])
    slack = np.frombuffer(b"".join(pdf["slack"]), dtype=np.uint8)
    cls = np.frombuffer(b"".join(pdf["ids"]), dtype=np.int64)
    if p < 0:
        out = pd.DataFrame({"kind": slack.astype(np.int32), "a": np.frombuffer(b"".join(pdf["keys"]), dtype=np.int64), "b": cls})
        return out.drop_duplicates() if len(out) else out
    key = np.frombuffer(b"".join(pdf["keys"]), dtype=np.uint32)
    order = np.argsort(key, kind="stable")
    key, cls, slack = key[order], cls[order], slack[order].astype(np.int64)
    same = key[1:] == key[:-1]
    met = np.r_[same, False] | np.r_[False, same] | (slack >= STANDS)
    first, of, key, cls, least, stands = runs(key[met], cls[met], slack[met])
    size = np.diff(np.r_[first, len(key)])
    big = (size > SMALL) | (stands > 0)
    pairs = [np.empty((2, 0), dtype=np.int64)]
    for off in range(1, SMALL):
        i = np.flatnonzero((of[off:] == of[:-off]) & ~big[of[off:]]) if len(of) > off else np.empty(0, dtype=np.int64)
        pairs.append(np.stack([cls[i], cls[i + off]]))
    large = big[of]
    star = large & (np.arange(len(of)) != first[of])
    pairs.append(np.stack([cls[first[of[star]]], cls[star]]))
    pairs = np.unique(np.concatenate(pairs, axis=1), axis=1)
    c, k = large_counts(cls[large], least[of[large]])
    names = (np.int64(p) << np.int64(32)) | key[first[big]].astype(np.int64)
    kinds = np.repeat(np.array([PAIR, LARGE, NAME], dtype=np.int32), [pairs.shape[1], len(c), len(names)])
    return pd.DataFrame({"kind": kinds, "a": np.r_[pairs[0], c, names], "b": np.r_[pairs[1], k, np.zeros(len(names), dtype=np.int64)]})


def _near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose sizes and dense sketches allow a link."""
    for pdf in batches:
        na, nb = pdf["na"].to_numpy(), pdf["nb"].to_numpy()
        may = np.minimum(na, nb) * 100 >= np.maximum(na, nb) * PER_CENT
        for i in np.flatnonzero(may):
            x, y = (np.frombuffer(pdf[c].iat[i], dtype=np.uint8) for c in ("sa", "sb"))
            small = min(len(x), len(y))
            may[i] = np.bitwise_count(folded(x, small) ^ folded(y, small)).sum() <= max_difference(na[i], nb[i])
        yield pdf.loc[may, ["a", "b", "ra", "rb"]]


def near(pairs: DataFrame, info: DataFrame) -> DataFrame:
    """Of pairs of classes (a, b) those that may be linked, in order of (ra, rb), their documents."""
    pairs = pairs.join(info.toDF("a", "ra", "na", "sa"), "a").join(info.toDF("b", "rb", "nb", "sb"), "b")
    return pairs.mapInPandas(_near, "a long, b long, ra long, rb long")


def forest(x: np.ndarray, y: np.ndarray, lab: np.ndarray) -> np.ndarray:
    """Of edges x, y between labelled nodes the places of those that join all that the edges can join, the first ones
    where there is a choice: each label takes its first edge, what is joined becomes one label, and again."""
    chosen = [np.empty(0, dtype=np.int64)]
    lab = np.unique(lab, return_inverse=True)[1]
    while len(live := np.flatnonzero(lab[x] != lab[y])):
        ends = np.stack([lab[x[live]], lab[y[live]]], axis=1)
        labels, first = np.unique(ends.ravel(), return_index=True)
        pick = first // 2
        chosen.append(np.unique(live[pick]))
        parent = np.arange(lab.max() + 1)
        parent[labels] = ends[pick].sum(axis=1) - labels
        # two labels that took the same edge
        top = np.arange(len(parent))
        parent = np.where((parent[parent] == top) & (top < parent), top, parent)
        while (parent[parent] != parent).any():
            parent = parent[parent]
        lab = parent[lab]
    return np.concatenate(chosen)


def near_pairs(n: np.ndarray, comp: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components whose sizes and sketches allow a link, the closest first."""
    size = min(map(len, sketch))
    bits = np.stack([folded(np.frombuffer(x, dtype=np.uint8), size) for x in sketch]).view(np.uint64)
    xs, ys, close = [], [], []
    every = np.arange(len(n))
    rows = max(1, (1 << 18) // (len(n) * bits.shape[1]))
    for at in range(0, len(n), rows):
        i = every[at : at + rows, None]
        may = (i < every) & (comp[i] != comp) & (np.minimum(n[i], n) * 100 >= np.maximum(n[i], n) * PER_CENT)
        x, y = np.nonzero(may)
        if len(x):
            x += at
            apart, most = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64), max_difference(n[x], n[y])
            ok = apart <= most
            xs.append(x[ok])
            ys.append(y[ok])
            close.append(apart[ok] / (most[ok] + 1))
    if not xs:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    order = np.argsort(np.concatenate(close), kind="stable")
    return np.concatenate(xs)[order], np.concatenate(ys)[order]


def _squares(all_pairs: bool):
    """Pairs of squares of large blocks that may be linked: all between different components or, where these are more than
    the square has members, a forest of them and the name of the block, which is open then."""

    def squares(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("square", kind="stable")
        n, comp, cls, rep = (pdf[c].to_numpy() for c in ("n", "comp", "cls", "rep"))
        square, block, sketch = (pdf[c].to_numpy() for c in ("square", "block", "sketch"))
        cut = np.r_[np.flatnonzero(np.r_[True, square[1:] != square[:-1]]), len(pdf)]
        out, left = [np.empty((2, 0), dtype=np.int64)], set()
        for a, z in zip(cut[:-1], cut[1:], strict=True):
            if comp[a:z].min() != comp[a:z].max():
                x, y = near_pairs(n[a:z], comp[a:z], sketch[a:z])
                if not all_pairs and len(x) > z - a:
                    tree = forest(x, y, comp[a:z])
                    x, y = x[tree], y[tree]
                    left.add(block[a])
                out.append(np.stack([a + x, a + y]))
        i, j = np.concatenate(out, axis=1)
        flip = rep[i] > rep[j]
        i, j = np.where(flip, j, i), np.where(flip, i, j)
        pairs = pd.DataFrame({"a": cls[i], "b": cls[j], "ra": rep[i], "rb": rep[j]}).drop_duplicates().astype("Int64")
        names = pd.DataFrame({"open": pd.array(sorted(left), dtype="Int64")})
        return pd.concat([pairs, names], ignore_index=True)[["a", "b", "ra", "rb", "open"]]

    return squares


def large_block_pairs(member: DataFrame, info: DataFrame, all_pairs: bool) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b, ra, rb) among the members (block, cls, comp, size, the block's) of large blocks, and the blocks that
    aren't done with these."""
    # each member goes to one of size / CHUNK cuts of its block, and each cut meets each
    m = member.withColumn("cuts", F.ceil(F.col("size") / CHUNK).cast("int"))
    rows_met = m.agg(F.coalesce(F.sum("cuts"), F.lit(0))).first()[0]
    m = m.withColumn("cut", F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int"))
    m = m.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    square = F.xxhash64("block", F.least("cut", "other"), F.greatest("cut", "other"))
    m = m.select(square.alias("square"), "block", "cls", "comp").join(info, "cls")
    # many small squares are handled together
    m = m.withColumn("hand", F.pmod("square", F.lit(1 + rows_met // HANDFUL)))
    met = checkpoint(m.groupBy("hand").applyInPandas(_squares(all_pairs), "a long, b long, ra long, rb long, open long").distinct())
    return met.filter("open is null").drop("open"), met.filter("open is not null").select(F.col("open").alias("block"))


def _arrays(wanted):
    """doc_id, class and shingles of the documents in a bit set."""

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[members(wanted.value, pdf["doc_id"].to_numpy(dtype=np.int64))]
            ids = iter(pdf["doc_id"])
            for raws in slices(pdf["text"]):
                sets = shingles(raws)
                some = list(islice(ids, len(raws)))
                yield pd.DataFrame({"id": some, "cls": [class_id(s)[0] for s in sets], "s": [s.view(np.int64) for s in sets]})

    return arrays


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b: classes; ra, rb: their documents), those that are linked, as rows (ra, rb).

    Texts are read once and not shuffled: the documents are found by a bit set. Only their shingles are.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("cls"), F.col("ra").alias("id")), F.struct(F.col("b").alias("cls"), F.col("rb").alias("id"))))
    want = pairs.select("ra", "rb", ends.alias("e")).select("ra", "rb", "e.cls", "e.id")
    wanted = bit_set(want.select("id"))
    sets = docs.filter("doc_id is not null").select("doc_id", "text").mapInPandas(_arrays(wanted), "id long, cls long, s array<long>")
    # each pair has two sets, and they differ
    both = want.join(sets, ["id", "cls"]).groupBy("ra", "rb").agg(F.min("s").alias("x"), F.max("s").alias("y"))
    both = both.select("ra", "rb", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return both.filter(F.col("common") * 100 >= (F.col("total") - F.col("common")) * PER_CENT).select("ra", "rb")


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of edges (u, v), and for each the smallest node that it reaches, where that is another."""
    nodes, at = np.unique(np.r_[u, v], return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while (least[x] != least[y]).any():
        low = np.minimum(least[x], least[y])
        for end in (least[x], least[y]):
            np.minimum.at(least, end, low)
        while (least[least] != least).any():
            least = least[least]
    moved = least != np.arange(len(nodes))
    return nodes[moved], nodes[least[moved]]


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges of a task with the same components, from each node to the smallest; BROADCAST_EDGES are taken together."""
    held, n = [], 0
    for pdf in batches:
        held.append(pdf.to_numpy(dtype=np.int64))
        n += len(pdf)
        if n > BROADCAST_EDGES:
            yield pd.DataFrame(np.stack(stars(*np.concatenate(held).T), axis=1), columns=["u", "v"])
            held, n = [], 0
    if held:
        yield pd.DataFrame(np.stack(stars(*np.concatenate(held).T), axis=1), columns=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node that it reaches) for the nodes of edges (ra, rb) that aren't the smallest.

    Each task first joins what its own edges join, so that rounds are needed only where there are several tasks. Up to
    BROADCAST_EDGES edges the least neighbours, and the result, are broadcast and few tasks read
    the edges; beyond it both sides are shuffled.
    """
    e = checkpoint(edges.select(F.greatest("ra", "rb").alias("u"), F.least("ra", "rb").alias("v")).filter("u != v"))
    n = e.count()
    few = n <= BROADCAST_EDGES
    e = checkpoint((e.coalesce(1 + n // TASK_EDGES) if few else e).mapInPandas(_stars, "u long, v long"))
    told, done = None, few and n < TASK_EDGES
    while not done:
        near = F.broadcast if few else lambda df: df
        both = e.union(e.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the least neighbour
        e1 = both.join(near(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        e1 = e1 if few else e1.distinct()
        # small star: smaller neighbours, and the node itself, go to the least one
        least = e1.groupBy("u").agg(F.min("v").alias("m"))
        e2 = e1.join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v")).filter("u != v").distinct()
        e = checkpoint(e2.coalesce(1 + n // TASK_EDGES) if few else e2)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == told:
            e = e.groupBy("u").agg(F.min("v").alias("v"))
            done = True
        told, n = now, now[0]
        few = n <= BROADCAST_EDGES
    e = e.toDF("node", "comp")
    return F.broadcast(e) if few else e


def _again(groups: int, common, wanted, names):
    """rep (the document), cls, block and slack for the blocks of the documents in a bit set, those in names last; and a row
    without a block for each document, with its size and sharp sketch."""

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[members(wanted.value, pdf["doc_id"].to_numpy(dtype=np.int64))]
            ids = iter(pdf["doc_id"])
            for raws in slices(pdf["text"]):
                sets = [(i, s) for i, s in zip(islice(ids, len(raws)), shingles(raws), strict=True) if len(s)]
                if sets:
                    keys, owners, slack = tokens_of([s for _, s in sets], groups, common.value, names.value)
                    cls = np.array([class_id(s)[0] for _, s in sets], dtype=np.int64)
                    doc = np.array([i for i, _ in sets], dtype=np.int64)
                    size = pd.array([len(s) for _, s in sets], dtype="Int64")
                    yield pd.DataFrame({"rep": doc, "cls": cls, "block": pd.array([None] * len(doc), dtype="Int64"), "slack": 0, "n": size, "sketch": [dense_sketch(s, SHARP) for _, s in sets]})
                    none = pd.array([None] * len(keys), dtype="Int64")
                    yield pd.DataFrame({"rep": doc[owners], "cls": cls[owners], "block": block_name(keys, groups), "slack": slack.astype(np.int32), "n": none, "sketch": None})

    return again


def labelled(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with comp, the component of their rep: rep itself where no edge is known."""
    return rows.join(comp.toDF("rep", "found"), "rep", "left").withColumn("comp", F.coalesce("found", "rep")).drop("found")


def mixed(rows: DataFrame) -> DataFrame:
    """Rows of blocks (block, cls, comp, slack) that are in different components, with size, the block's, and least, its slack."""
    split = rows.groupBy("block").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"), F.min("slack").alias("least"))
    return rows.join(split.filter("lo != hi").select("block", "size", "least"), "block")


def joined(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components with further edges (ra, rb)."""
    return components(comp.toDF("ra", "rb").union(edges))


def missed_edges(docs: DataFrame, rows: DataFrame, info: DataFrame, met: DataFrame, comp: DataFrame, groups: int, common) -> DataFrame:
    """Components with the links of pairs that have only large blocks in common."""
    counts = met.filter(F.col("kind") == LARGE).groupBy(F.col("a").alias("cls"))
    counts = counts.agg(F.sum(F.shiftright("b", 3)).alias("k"), F.min(F.col("b").bitwiseAND(7)).alias("least")).filter("k > least")
    again = checkpoint(counts.select("cls").join(info.select("cls", "rep"), "cls"))
    if not again.take(1):
        return comp
    wanted = bit_set(again.select("rep"))
    names = bit_set(met.filter(F.col("kind") == NAME).select("a"))
    given = rows.filter("doc_id is not null").mapInPandas(_again(groups, common, wanted, names), "rep long, cls long, block long, slack int, n long, sketch binary")
    # only the document that stands for a class
    given = checkpoint(given.join(again, ["rep", "cls"]))
    info = given.filter("block is null").select("cls", "rep", "n", "sketch")
    blocks = mixed(labelled(given.filter("block is not null").select("block", "cls", "rep", "slack"), comp))
    blocks = checkpoint(blocks.select("block", "cls", "rep", "comp", "slack", "size", "least"))

    small = blocks.filter(F.col("size") <= SMALL).select("block", "cls", "comp")
    other = small.toDF("block", "b", "comp_b")
    pairs = small.withColumnRenamed("cls", "a").join(other, "block").filter("a < b and comp != comp_b").select("a", "b").distinct()
    comp = joined(comp, verified(docs, checkpoint(near(pairs, info))))

    large = blocks.filter(F.col("size") > SMALL)
    for step in ("largest", "forest", "all"):
        if step == "all":
            # what the squares of a block that isn't open found was verified
            member = mixed(labelled(member.join(left, "block", "left_semi").select("block", "cls", "rep", "slack"), comp))
        else:
            # a pair that is still missed has more large blocks in common than the least slack, so that the smallest of these
            # is not among the so many largest of either set: those need not be compared
            live = mixed(labelled(large.select("block", "cls", "rep", "slack"), comp))
            of_class = Window.partitionBy("cls")
            live = live.withColumn("floor", F.min("least").over(of_class))
            live = live.withColumn("place", F.row_number().over(of_class.orderBy(F.desc("size"), "block"))).filter("place > floor")
            member = mixed(live.select("block", "cls", "rep", "slack", "comp"))
        member = checkpoint(member.select("block", "cls", "rep", "slack", "comp", "size"))
        if not member.take(1):
            break
        some = member
        if step == "largest":
            # first each in one block only, so that a group of near copies meets once and not in each of its blocks
            some = member.withColumn("one", F.max(F.struct("size", "block")).over(of_class)).filter("block = one.block").select("block", "cls", "comp")
            some = checkpoint(some.join(some.groupBy("block").agg(F.count("*").alias("size")), "block"))
        more, left = large_block_pairs(some.select("block", "cls", "comp", "size"), info, step == "all")
        if more.take(1):
            comp = joined(comp, verified(docs, more))
    return comp


def similarity_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    component_id is the smallest doc_id that can be reached over links. Null, empty
    and blank texts have no shingles and are linked with nothing; nor is a row with
    a null doc_id, whose component_id is null. Rows that share a doc_id share its
    links; repeated rows come out as often. Of ties, which there are none but equal
    sets, all are one class. Very long texts are used whole. An empty table gives no
    rows. Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    rows = spread(docs.select("doc_id", "text"))
    seen = checkpoint(rows.select(told("doc_id"), "text").mapInPandas(_describe, "doc_id string, doc boolean, n long, d1 long, d2 long, sketch binary"))
    of = untold(seen.filter("doc").drop("doc"))
    n_docs, total = of.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    common = seen.filter("not doc").groupBy("d1").agg(F.sum("n").alias("k")).filter(F.col("k") >= max(32, n_docs // (4 * COMMON)))
    common = common.orderBy(F.desc("k"), "d1").limit(MOST_COMMON).select("d1").toPandas()["d1"].to_numpy(dtype=np.int64)
    shared = spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))

    usable = of.filter("n > 0 and doc_id is not null")
    classes = usable.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = checkpoint(classes)
    info = classes.select(F.col("d1").alias("cls"), "rep", "n", "sketch")

    groups = max(1, -(-total // (2 * GROUP_KEYS)))
    packed = rows.filter("doc_id is not null").mapInPandas(_pack(groups, shared), "p int, keys binary, ids binary, slack binary")
    met = checkpoint(packed.groupBy("p").applyInPandas(_meet, "kind int, a long, b long"))

    pairs = met.filter(F.col("kind") == PAIR).select("a", "b").distinct()
    comp = components(verified(docs, checkpoint(near(pairs, info))))
    comp = missed_edges(docs, rows, info, met, comp, groups, shared)

    # classes first, which are joined with the documents once
    of_class = classes.select("d1", "d2", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    of_class = of_class.select("d1", "d2", F.coalesce("comp", "rep").alias("least"))
    return of.join(of_class, ["d1", "d2"], "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; all columns stay, whatever their names.

    Every row is a document, also where rows share a doc_id or have none: then rows
    are numbered for the purpose, a row without a doc_id comes after all others,
    and of rows with the same doc_id any one may stay. Rows without a word (null,
    empty or blank) are in components of their own and stay. An empty table stays
    empty. Texts are used whole.
    """
    if docs.groupBy("doc_id").agg(F.count("*").alias("k")).filter("doc_id is null or k > 1").isEmpty():
        gone = fresh(docs, "gone")
        found = similarity_components(docs).filter("component_id != doc_id").select(F.col("doc_id").alias(gone))
        return docs.join(found.hint("shuffle_hash"), docs["doc_id"] == F.col(gone), "left_anti")
    # numbers given once and written out, so that a lost executor can't change them
    rows = checkpoint(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("nr")))
    found = similarity_components(rows.select(F.col("nr").alias("doc_id"), F.col("row.text").alias("text")))
    found = found.select(F.col("doc_id").alias("nr"), "component_id").join(rows.select("nr", F.col("row.doc_id").alias("id")), "nr")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "nr"))
    kept = found.groupBy("component_id").agg(first.alias("first")).select(F.col("first.nr").alias("kept_nr"))
    return rows.join(kept.hint("shuffle_hash"), rows["nr"] == F.col("kept_nr"), "left_semi").select("row.*")
