"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments.  With radii ``t`` whose sum is
``distance - segments + 1``, two fingerprints within ``distance`` bits agree to within
``t[k]`` bits in some segment k (else they would differ in at least
``sum(t[k] + 1) = distance + 1`` bits).  So every fingerprint enters one table per
segment, and looks up the small Hamming ball around each of its segment values.  Of two
values one bit apart one has the 0 there, so only zero bits are flipped.  What a lookup
fetches is compared in full.

Skew: equal fingerprints are merged first.  In table buckets over ``bucket`` fingerprints
(families of near copies) each is held against the bucket's leader, and only what is not near
it is compared with the others (``blocks``): no link is lost, no list of all pairs is made.

``near_groups`` and ``one_of_each`` work at a similarity of 0.8 of five-word shingles; see there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .batches import NOT_SPACE, chunks, free_name, lower_ascii, mix, narrow, runs, texts, with_columns, word_hashes, words
from .blocks import pairs_of_blocks
from .graph import connected_components, forest
from .lookup import BROADCAST_ROWS, inner_lookup, skew_join
from .scratch import cut

#: Each bit of a byte in a byte of its own, so that 255 of them can be added at a time.
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).copy().view(np.uint64).ravel()
#: Rows of hashes whose bits are spread out at a time (a very long text has more).
_ROWS = 255 * 32


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``shingle`` words, repeats included; of fewer words the one of all."""
    words = text.lower().split()  # of bytes: A-Z only, and white space 0x20 and 0x09-0x0D
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    return np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)], np.uint64, n)


def ones(hashes: np.ndarray) -> np.ndarray:
    """How often each bit of each column is set: (columns x 64) of rows x columns."""
    total = np.zeros((hashes.shape[1], 64), np.int64)
    for i in range(0, len(hashes), _ROWS):
        part = hashes[i : i + _ROWS]
        rows = np.zeros((-(-len(part) // 255) * 255, hashes.shape[1]), np.uint64)
        rows[: len(part)] = part
        spread = _SPREAD[rows.view(np.uint8)].reshape(-1, 255, hashes.shape[1] * 8).sum(axis=1)
        total += spread.view(np.uint8).reshape(-1, hashes.shape[1], 64).sum(axis=0, dtype=np.int64)
    return total


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half the hashes; none: 0."""
    return np.packbits(ones(hashes[:, None]) * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of one text's UTF-8 bytes, as an unsigned number."""
    return int(majority(shingle_hashes(text, shingle)))


def with_fingerprint(df: DataFrame, text: str = "text", shingle: int = 4, name: str = "fp") -> DataFrame:
    """``df`` and its fingerprints as signed longs.  Null, empty and wordless texts: 0."""

    def column(values: pa.Array) -> list[pa.Array]:
        prints = [fingerprint(v.as_buffer().to_pybytes() if v.is_valid else b"", shingle) for v in values.cast(pa.large_binary())]
        return [pa.array(np.array(prints, np.uint64).view(np.int64))]

    return with_columns(df, text, T.StructType([T.StructField(name, T.LongType())]), column)


def _segments(distance: int, parts: int) -> list[tuple[int, int, int]]:
    """(lowest bit, width, radius) of each segment; radii differ by one at most."""
    radii = distance - parts + 1
    if radii < 0:
        raise ValueError("more segments than distance + 1")
    cuts = [64 * k // parts for k in range(parts + 1)]
    out = [(cuts[k], cuts[k + 1] - cuts[k], (radii + parts - 1 - k) // parts) for k in range(parts)]
    if any(width > 56 for _, width, _ in out):
        raise ValueError("two segments at least are needed")
    return out


def _ball(value: F.Column, width: int, radius: int) -> F.Column:
    """The values that follow from ``value`` by setting 1 to ``radius`` of its bits, or by changing others with them.

    Radius 1 needs zero bits only.  From radius 2 on a pair may differ by bits set on either
    side, so the whole ball is listed (without its centre).
    """
    masks = {0}
    shell = {0}
    for _ in range(radius):
        shell = {m ^ (1 << b) for m in shell for b in range(width)} - masks
        masks |= shell
    listed = F.array(*[F.lit(m).cast("long") for m in sorted(masks - {0})])
    if radius == 1:
        return F.transform(F.filter(listed, lambda m: value.bitwiseAND(m) == 0), lambda m: value.bitwiseOR(m))
    return F.transform(listed, lambda m: value.bitwiseXOR(m))


def _tagged(values: F.Column, tag: F.Column) -> F.Column:
    return F.transform(values, lambda x: x + tag)


def _near(distance: int) -> F.Column:
    return F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance


def _forest(prints: np.ndarray, other: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what is joined between ``prints`` and ``other``, at most one for each fingerprint."""
    both = np.concatenate([prints, other])
    parent = np.arange(len(both))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(prints)):
        for j in (np.flatnonzero(np.bitwise_count(other ^ both[i]) <= distance) + len(prints)).tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                if both[i] != both[j]:
                    out.append((int(both[i]), int(both[j])))
    return out


def links(prints: DataFrame, distance: int = 4, parts: int | None = None, bucket: int = 32, block: int = 2048) -> DataFrame:
    """(a, b): links whose components are those of all pairs of ``prints`` within ``distance`` bits.

    ``prints`` has one column ``fp`` of distinct longs.  ``parts`` segments: 3, or 2 from
    2**24 fingerprints on, where the buckets of 3 would be crowded; the links are complete for
    any number.  A bucket over ``bucket`` is cut into blocks of about ``block``.
    """
    if parts is None:
        parts = 3 if prints.count() < 1 << 24 else 2
    segments = _segments(distance, parts)
    value = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width, _ in segments]
    tag = [F.lit(k << 56) for k in range(parts)]
    table = prints.select("fp", F.explode(F.array(*[v + t for v, t in zip(value, tag, strict=True)])).alias("key"))
    balls = [_tagged(_ball(v, width, radius), t) for v, t, (_, width, radius) in zip(value, tag, segments, strict=True) if radius]
    crowded = cut(table.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("leader")).filter(F.col("n") > bucket).drop("n"))
    n_crowded = crowded.count()
    probes = prints.select("fp", F.explode(F.concat(*balls)).alias("key")) if balls else None

    cold = table.join(crowded, "key", "left_anti")
    own = cold.select("key", F.col("fp").alias("b"))
    found = cold.select("key", F.col("fp").alias("a")).join(own, "key").filter((F.col("a") < F.col("b")) & _near(distance)).select("a", "b")
    if probes is not None:
        found = found.unionByName(probes.select("key", F.col("fp").alias("a")).join(own, "key").filter((F.col("a") != F.col("b")) & _near(distance)).select("a", "b"))
    if not n_crowded:
        return found

    # Crowded buckets: members and those that look them up, first against the leader.
    sides = table.withColumn("member", F.lit(True))
    if probes is not None:
        sides = sides.unionByName(probes.withColumn("member", F.lit(False)).select(*sides.columns))
    sides = cut(inner_lookup(sides, crowded, "key", n_crowded).withColumn("near", F.bit_count(F.col("fp").bitwiseXOR(F.col("leader"))) <= distance))
    attached = sides.filter(F.col("near") & (F.col("fp") != F.col("leader"))).select(F.col("fp").alias("a"), F.col("leader").alias("b"))
    # A member that isn't near the leader may be near to any row that meets the bucket; a row that looks it up, to any member.
    members, free = sides.filter("member").select("key", "fp"), sides.filter("not near")
    every = sides.select("key", "fp")
    dealt = [pairs_of_blocks(left, right.select("key", "fp"), "key", "fp", block) for left, right in ((every, free.filter("member")), (members, free.filter("not member")))]

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        own, side = rows["fp"].to_numpy().view(np.uint64), rows["side"].to_numpy()
        made = _forest(own[side == 0], own[side == 1], distance)
        return pd.DataFrame(np.array(made, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    found = found.unionByName(attached)
    for part in dealt:
        found = found.unionByName(part.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long"))
    return found


def components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4, distance: int = 4, **options: int) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    ``fingerprint``: 16 lower-case hex digits.  ``component_id``: the least id that links of
    ``distance`` bits or fewer reach, the row's own included.  Null and wordless texts have
    fingerprint 0 and are linked like any other.  Repeated rows stay repeated.  Null ids get
    the component of their fingerprint (null if no id is known there).  Empty table: empty.
    """
    rows = cut(with_fingerprint(narrow(df, doc_id=doc_id, text=text), "text", shingle).select("doc_id", "fp"))
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    group = connected_components(links(least.select("fp"), distance, **options))
    named = least.join(group.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    known = cut(named.select("fp", F.col("root"), "least"))
    of_print = _with_least(known, "component_id").select("fp", "component_id")
    return skew_join(rows, of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _with_least(named: DataFrame, name: str) -> DataFrame:
    """``named`` (root, least, ...) and the least ``least`` of each root; a root may hold most rows."""
    return skew_join(named, named.groupBy("root").agg(F.min("least").alias(name)), "root")


# Similarity 0.8.
#
# Two texts that share 0.8 of their five-word shingles differ in some 15 % of SimHash bits:
# too many for small balls in few segments of one 64-bit word, and too few bits to tell them from texts
# that share less.  So WORDS independent words are taken, each cut into three segments.  Which
# bits differ is no accident: those whose votes are nearly even.  So the ball around a segment
# value holds the values made by changing any of its FLIPS most even bits (2 ** FLIPS of them, with up to
# FLIPS changes).  Measured on random texts at a similarity of just 0.8, a segment finds a
# pair with a chance of 0.3 that way (0.16 for all values one bit off), one of 12 with 0.98.
# Texts of at most SHORT shingles have too few votes; they are found by shared shingles too: of
# two with a similarity of 0.8 or more both have one in their first n - ceil(0.8 n) + 1 by hash.
#
# What is fetched must be near in 64 bits that the key doesn't hold (the rest of that word, and the next
# word's bits in the segment's place), then over all WORDS x 64 bits.  Pairs that pass
# make candidate groups; within these, the exact Jaccard similarity of the sets of shingles decides.
# Families are contracted first by their equal segment values, so that no family is paired with itself.

WORDS = 4
FLIPS = 4
SHORT = 32
#: Of 256 bits: the mean at similarity 0.8 (37) and three and a half standard deviations.
WIDE_DISTANCE = 57
#: Of the 64 bits beside a key: the mean at similarity 0.8 (9.3) and nearly three and a half standard deviations.
WORD_DISTANCE = 19
#: Rows of a candidate group that one task compares at most.
GROUP = 4096
_SHORT_TAG = WORDS * 3


def shingle_sets(values: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct hashes of each text's shingles, ascending; fewer words: the one of them all; none: none."""
    data, offsets = texts(values)
    for i, j in chunks(offsets):
        x = lower_ascii(data[offsets[i] : offsets[j]])
        starts, ends, first = words(x, offsets[i : j + 1] - offsets[i], NOT_SPACE)
        h = word_hashes(x, starts, ends)
        whole = runs(h, shingle)
        for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(whole[a : z - shingle + 1]) if z - a >= shingle else runs(h[a:z], z - a) if z > a else h[:0]


_keys = mix(np.arange(1, WORDS + 1, dtype=np.uint64))


def _wide(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(number of shingles and WORDS fingerprints; the places of each segment's FLIPS most even bits) of each set."""
    n = np.array([len(x) for x in sets], np.int64)
    votes = np.stack([ones(mix(x[:, None] ^ _keys)) for x in sets]) if len(sets) else np.zeros((0, WORDS, 64), np.int64)
    margin = 2 * votes - n[:, None, None]
    prints = np.packbits(margin > 0, axis=2, bitorder="little").view(np.int64)[:, :, 0]
    masks = np.empty((len(sets), WORDS, 3, FLIPS), np.int8)
    for k, (low, width, _) in enumerate(_segments(2, 3)):
        even = np.argsort(np.abs(margin[:, :, low : low + width]), axis=2, kind="stable")[:, :, :FLIPS]
        masks[:, :, k] = even
    return np.concatenate([n[:, None], prints], axis=1), masks.reshape(len(sets), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1], np.ascontiguousarray(rows).ravel())


def with_wide_fingerprint(df: DataFrame, text: str = "text", shingle: int = 5) -> DataFrame:
    """``df`` and ``words`` (number of shingles, WORDS fingerprints), ``masks`` and ``keys`` (of short texts)."""

    def column(values: pa.Array) -> list[pa.Array]:
        wide, masks, keys = [], [], []
        sets: list[np.ndarray] = []

        def flush() -> None:
            a, b = _wide(sets)
            wide.append(a)
            masks.append(b)
            sets.clear()

        for own in shingle_sets(values, shingle):
            n = len(own)
            first = own[: n - -(-4 * n // 5) + 1] if n else np.zeros(1, np.uint64)
            keys.append((first >> np.uint64(8)).astype(np.int64) | _SHORT_TAG << 56 if n <= SHORT else np.zeros(0, np.int64))
            sets.append(own)
            if len(sets) == 512:
                flush()
        flush()
        ends = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        return [_lists(np.concatenate(wide)), _lists(np.concatenate(masks)), pa.ListArray.from_arrays(ends, np.concatenate([*keys, np.zeros(0, np.int64)]))]

    return with_columns(df, text, T._parse_datatype_string("words array<long>, masks array<byte>, keys array<long>"), column)


def _wide_near(x: str, y: str, distance: int) -> F.Column:
    apart = sum((F.bit_count(F.get(x, F.lit(w)).bitwiseXOR(F.get(y, F.lit(w)))) for w in range(1, WORDS + 1)), F.lit(0))
    return (apart <= distance) | (F.greatest(F.get(x, F.lit(0)), F.get(y, F.lit(0))) <= SHORT)


def _entries(prints: DataFrame, changes: int) -> DataFrame:
    """(id, root, key, word): each segment's value (``changes`` 1), or the values made by each other choice of its FLIPS bits.

    ``word``: the 64 bits that go with the key, without the segment's own.
    """
    cuts = _segments(2, 3)
    q = F.col("q")
    t = F.floor(q / changes).cast("int") if changes > 1 else q
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values] * WORDS), t + 1)
    place = F.floor(t / 3).cast("int")
    word, beside = F.get("words", place + 1), F.get("words", (place + 1) % WORDS + 1)
    value = F.call_function("shiftrightunsigned", word, of([low for low, _, _ in cuts])).bitwiseAND(of([(1 << width) - 1 for _, width, _ in cuts]))
    if changes > 1:
        i = q % changes + 1
        for f in range(FLIPS):
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.get("masks", t * FLIPS + f).cast("int"))
            value = value.bitwiseXOR(F.when(i.bitwiseAND(F.lit(1 << f)) != 0, bit).otherwise(F.lit(0).cast("long")))
    masks = [((1 << width) - 1) << low for low, width, _ in cuts]
    own = of([m - (1 << 64) if m >> 63 else m for m in masks])
    rest = word.bitwiseXOR(word.bitwiseXOR(beside).bitwiseAND(own))
    rows = prints.select("id", "root", "words", "masks", F.explode(F.sequence(F.lit(0), F.lit(WORDS * 3 * changes - 1))).alias("q"))
    return rows.select("id", "root", (value + F.shiftleft(t.cast("long"), 56)).alias("key"), rest.alias("word"))


def _table(prints: DataFrame) -> DataFrame:
    """The entries that are looked up: segment values, and shingles of short texts."""
    short = prints.select("id", "root", F.explode("keys").alias("key"), F.lit(0).cast("long").alias("word"))
    return _entries(prints, 1).unionByName(short)


def _confirmed(pairs: DataFrame, prints: DataFrame, distance: int) -> DataFrame:
    """The pairs (a, b) that are near over all bits."""
    side = lambda of, name: prints.select(F.col("id").alias(of), F.col("words").alias(name))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").filter(_wide_near("x", "y", distance)).select("a", "b")


def _families(prints: DataFrame, distance: int, near: F.Column) -> DataFrame:
    """``prints`` and ``root``: the least row that links to bucket leaders near a row lead to, else its own id.

    A row meets one leader a bucket, in the buckets of its own values and of those that its two most even bits give, so
    the links are as many as the rows at most, times a fixed number.  Roots only spare pairs that are connected already.
    """
    blank = prints.withColumn("root", F.lit(None).cast("long"))
    table = _table(blank).drop("root")
    heads = cut(table.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "word")).alias("head")).select("key", F.col("head.id").alias("leader"), F.col("head.word").alias("v"), "n"))
    own = skew_join(table, heads.filter("n > 1").drop("n"), "key")
    met = own.unionByName(skew_join(_entries(blank, 3).drop("root"), heads.drop("n"), "key"))
    pairs = met.filter((F.col("id") != F.col("leader")) & near).select(F.greatest("id", "leader").alias("a"), F.least("id", "leader").alias("b")).distinct()
    links = cut(_confirmed(pairs, prints, distance))
    led = links.groupBy("a").agg(F.min("b").alias("b"))
    for again in range(2):
        for _ in range(2):  # each time twice as far
            led = led.join(led.select(F.col("a").alias("b"), F.col("b").alias("next")), "b", "left").select("a", F.coalesce("next", "b").alias("b"))
        led = cut(led)
        if again:
            break
        # What is linked under another root brings both together: the greater root goes to the least.
        end = lambda of: led.select(F.col("a").alias(of), F.col("b").alias(f"{of}_root"))
        ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("a_root", "a").alias("x"), F.coalesce("b_root", "b").alias("y"))
        joined = ends.filter("x <> y").groupBy(F.greatest("x", "y").alias("a")).agg(F.min(F.least("x", "y")).alias("b"))
        led = led.join(joined, "a", "left_anti").unionByName(joined)
    return cut(_spread(prints.join(led.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").withColumn("root", F.coalesce("root", "id"))))


def _spread(prints: DataFrame) -> DataFrame:
    """``prints`` in as many partitions as the session shuffles to: each row becomes a hundred entries and more in the task that reads it."""
    return prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def wide_links(prints: DataFrame, distance: int = WIDE_DISTANCE, word_distance: int = WORD_DISTANCE, bucket: int = 32, block: int = 1024) -> DataFrame:
    """(a, b): candidate links between rows of ``prints`` (id long, words, masks, keys) within ``distance`` bits in all.

    Their components are those of all pairs found.  First each row is linked to what the leaders near it lead to
    (``_families``); rows of one such root are looked up no more among themselves.  In buckets over ``bucket`` the rows not connected or near to the
    bucket's leader are held against all others, in blocks of about ``block``.
    """
    near = F.bit_count(F.col("word").bitwiseXOR(F.col("v"))) <= word_distance
    prints = _families(prints, distance, near)
    known = prints.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    table, probes = _table(prints), _entries(prints, (1 << FLIPS) - 1)
    crowded = cut(table.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("id", "root")).alias("head")).filter(F.col("n") > bucket).select("key", F.col("head.id").alias("leader"), F.col("head.root").alias("family")))
    n_crowded = crowded.count()
    marked = F.broadcast(crowded) if n_crowded <= BROADCAST_ROWS else crowded
    own = table.join(marked, "key", "left_anti").select("key", F.col("id").alias("b"), F.col("word").alias("v"), F.col("root").alias("other"))
    apart = (F.col("root") != F.col("other")) & near
    same = own.select("key", F.col("b").alias("a"), F.col("v").alias("word"), F.col("other").alias("root")).join(own, "key").filter((F.col("a") < F.col("b")) & apart).select("a", "b")
    beside = probes.withColumnRenamed("id", "a").join(own, "key").filter(apart).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # Each part on its own: the driver holds and plans again, after each of its stages, no more than one.
    pairs = cut(same.unionByName(beside).distinct())
    cold = forest(known.unionByName(_confirmed(pairs, prints, distance))).toDF("a", "b")
    if not n_crowded:
        return cold

    heads = cut(crowded.join(prints.select(F.col("id").alias("leader"), F.col("words").alias("y")), "leader"))
    limit = BROADCAST_ROWS // 4

    def held(entries: DataFrame, heads: DataFrame) -> DataFrame:
        rows = inner_lookup(entries.select("key", "id", "root"), heads, "key", n_crowded, limit=limit)
        if "loose" in heads.columns:
            rows = rows.filter("loose or root <> family")
        rows = rows.join(prints.select("id", F.col("words").alias("x")), "id")
        return cut(rows.select("key", "id", "leader", F.col("x").alias("words"), (F.col("root") == F.col("family")).alias("done"), ((F.col("root") == F.col("family")) | _wide_near("x", "y", distance)).alias("near")))

    # Members that aren't connected to the leader make a bucket loose: only there must those that are be held against them.
    members = held(table, heads)
    loose = members.filter("not near").select("key").distinct().withColumn("loose", F.lit(True))
    others = held(probes, heads.join(loose, "key", "left").withColumn("loose", F.coalesce("loose", F.lit(False))))
    every = members.unionByName(others)
    attached = every.filter("near and not done").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    columns = ["key", "id", "words"]
    free = lambda rows: rows.filter("not near").select(*columns)
    edge = T._parse_datatype_string("a long, b long")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "id"])
        made = _group_forest(rows["id"].to_numpy(), np.stack(rows["words"]).astype(np.int64), None, int((rows["side"] == 0).sum()), distance, 0.0)
        return pd.DataFrame(made, columns=["a", "b"]).astype("int64")

    found = cold.unionByName(attached)
    for left, right in ((every, free(members)), (members, free(others))):
        dealt = pairs_of_blocks(left.select(*columns), right, "key", "id", block)
        found = found.unionByName(forest(dealt.groupBy("key", "i", "j").applyInPandas(compare, edge)).toDF("a", "b"))
    return found


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether the Jaccard similarity of two ascending arrays of distinct values is ``least`` or more (of two empty ones it is 1)."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if len(small) < least * len(large):
        return False
    if not len(small):
        return True
    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
    return both >= least * (len(x) + len(y) - both) - 1e-9


def _group_forest(ids: np.ndarray, prints: np.ndarray, sets: list[np.ndarray] | None, left: int, distance: int, least: float) -> list[tuple[int, int]]:
    """Links between the first ``left`` rows and the others (0: among all rows), at most one for each row.

    Rows are linked if their ``prints`` are near and, where ``sets`` are given, these are similar; the
    nearest are looked at first, those that are connected already aren't.
    """
    n, sizes, words_ = len(ids), prints[:, 0], prints[:, 1:].view(np.uint64)
    parent = np.arange(n)

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(left or n):
        low = left or i + 1
        apart = np.bitwise_count(words_[low:] ^ words_[i]).sum(axis=1, dtype=np.int64)
        good = np.flatnonzero((apart <= distance) | (np.maximum(sizes[low:], sizes[i]) <= SHORT))
        for j in (good[np.argsort(apart[good], kind="stable")] + low).tolist():
            x, y = root(i), root(j)
            if x != y and (sets is None or similar(sets[i], sets[j], least)):
                parent[max(x, y)] = min(x, y)
                if ids[i] != ids[j]:
                    out.append((int(ids[i]), int(ids[j])))
    return out


_BODY = "id long, root long, size long, words array<long>, shingles binary"


def _bodies(rows: DataFrame, shingle: int) -> DataFrame:
    """(id, root, size, words, shingles) from (id, root, size, text): once a task for each id."""
    fields = T._parse_datatype_string(_BODY)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = []
            for i, x in enumerate(b.column(0).to_pylist()):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            for i in range(0, len(new), 256):
                part = b.take(pa.array(new[i : i + 256]))
                sets = list(shingle_sets(part.column(3), shingle))
                short = [np.unique((x >> np.uint64(32)).astype(np.uint32)) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), _lists(_wide(sets)[0]), pa.array([x.tobytes() for x in short], pa.binary())], names=fields.names)

    return rows.select("id", "root", "size", "text").mapInArrow(each, fields)


def _decoded(column: pa.Array | pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint32) for x in (column.to_pylist() if isinstance(column, pa.Array) else column)]


def _labels(ids: list[int], links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(id, least id of its component) of each id."""
    above = {i: i for i in ids}

    def root(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        above[high] = low
    return [(i, root(i)) for i in ids]


def verified_groups(docs: DataFrame, groups: DataFrame, shingle: int, least: float, distance: int, group: int) -> DataFrame:
    """(node, root): components of the links of similarity ``least`` or more within each candidate group.

    ``docs``: (id, doc_id, text); ``groups``: (id, doc_id, root, size), the doc_id being that of the one row read for an id.
    """
    n = groups.count()
    # Two numbers an id: a broadcast of tens of MB at most; beyond, by shuffle.
    chosen = inner_lookup(docs, groups.withColumnRenamed("doc_id", "one"), "id", n, limit=1_000_000).filter(F.col("doc_id").eqNullSafe(F.col("one")))
    edge = T._parse_datatype_string("a long, b long")
    label = T._parse_datatype_string("node long, root long")

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        current, out = None, []

        def finish() -> None:
            ids = np.array(list(held), np.int64)
            prints = np.array([p for p, _ in held.values()], np.int64).reshape(len(ids), WORDS + 1)
            out.extend(_labels(list(held), _group_forest(ids, prints, [s for _, s in held.values()], 0, distance, least)))
            held.clear()

        def flush() -> pa.RecordBatch:
            made = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0].copy()), pa.array(made[:, 1].copy())], names=label.names)

        for b in batches:
            sets = _decoded(b.column(4))
            for i, (x, g, words_) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True)):
                if g != current:
                    finish()
                    current = g
                held[x] = (np.array(words_, np.int64), sets[i])
            yield flush()
        finish()
        yield flush()

    small = _bodies(chosen.filter(F.col("size") <= group), shingle).repartition("root").sortWithinPartitions("root", "id").mapInArrow(within, label)
    if not groups.filter(F.col("size") > group).limit(1).count():
        return small

    # Large groups: of some candidates the one that most are near to is the leader; what isn't near it is held against all.
    body = cut(_bodies(chosen.filter(F.col("size") > group), shingle).select("id", "root", "words", "shingles"))
    seeds = range(4)
    leaders = body.groupBy("root").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), F.col("id"), F.col("shingles"))).alias(f"l{k}") for k in seeds])
    leaders = cut(leaders.select("root", F.array(*[F.struct(f"l{k}.id", f"l{k}.shingles") for k in seeds]).alias("leaders")))
    n_large = leaders.count()
    beside = inner_lookup(body, leaders, "root", n_large, limit=1000)
    held_type = T._parse_datatype_string("id long, root long, words array<long>, shingles binary, near array<int>, leader array<long>")

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for b in batches:
            near, names = [], []
            for i, (g, own) in enumerate(zip(b.column(1).to_pylist(), _decoded(b.column(3)), strict=True)):
                if g not in known:
                    if len(known) >= 64:
                        known.clear()
                    listed = b.column(4)[i].as_py()
                    known[g] = [r["id"] for r in listed], _decoded(pd.Series([r["shingles"] for r in listed]))
                near.append([int(similar(own, x, least)) for x in known[g][1]])
                names.append(known[g][0])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(near, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.int64()))], names=held_type.names)

    held = cut(beside.select("id", "root", "words", "shingles", "leaders").mapInArrow(hold, held_type))
    best = held.groupBy("root").agg(*[F.sum(F.get("near", F.lit(k))).alias(f"n{k}") for k in seeds])
    best = cut(best.select("root", F.greatest(*[F.struct(F.col(f"n{k}").alias("n"), F.lit(k).alias("k")) for k in seeds])["k"].alias("k")))
    held = inner_lookup(held, best, "root", n_large).select("id", "root", "words", "shingles", F.get("near", "k").alias("near"), F.get("leader", "k").alias("leader"))
    large = held.filter((F.col("near") == 1) & (F.col("id") != F.col("leader"))).select(F.col("id").alias("a"), F.col("leader").alias("b"))
    columns = ["root", "id", "words", "shingles"]
    dealt = pairs_of_blocks(held.select(*columns), held.filter("near = 0").select(*columns), "root", "id", group)

    def across(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "id"])
        made = _group_forest(rows["id"].to_numpy(), np.stack(rows["words"]).astype(np.int64), _decoded(rows["shingles"]), int((rows["side"] == 0).sum()), distance, least)
        return pd.DataFrame(made, columns=["a", "b"]).astype("int64")

    return small.unionByName(connected_components(large.unionByName(dealt.groupBy("root", "i", "j").applyInPandas(across, edge))))


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, least: float = 0.8, distance: int = WIDE_DISTANCE, group: int = GROUP, **options: int) -> DataFrame:
    """(doc_id, component_id): groups of texts linked by a Jaccard similarity of ``least`` (0.8 or more) of their sets of five-word shingles.

    Words are lower-cased (A-Z) and cut at ASCII white space; a text of fewer words has the one
    shingle of them all.  Null and wordless texts form one group; repeated rows stay repeated; null ids
    get the group's least known id.
    """
    base = narrow(df, doc_id=doc_id, text=text).withColumn("id", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = cut(with_wide_fingerprint(base, "text", shingle).select("doc_id", "id", "words", "masks", "keys"))
    prints = cut(_spread(rows.groupBy("id").agg(F.min("doc_id").alias("least"), *[F.min(c).alias(c) for c in ("words", "masks", "keys")])))
    linked = connected_components(wide_links(prints.drop("least"), distance, **options)).select(F.col("node").alias("id"), "root")
    groups = skew_join(linked, linked.groupBy("root").agg(F.count("*").alias("size")), "root").join(prints.select("id", F.col("least").alias("doc_id")), "id")
    same = verified_groups(base, cut(groups.select("id", "doc_id", "root", "size")), shingle, least, distance, group)
    named = cut(prints.select("id", "least").join(same.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    of_print = _with_least(named, "component_id").select("id", "component_id")
    return skew_join(rows.select("doc_id", "id"), of_print, "id").select("doc_id", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``df`` with one row of each group of near copies: that of the least id.

    Rows without an id stay, and so do rows of equal id.  Columns and their order stay as they are.
    """
    groups = near_groups(df, doc_id, text, **options)
    name = free_name(df, "__gone__")
    gone = cut(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct())
    if gone.count() <= 1_000_000:  # of one id each; beyond, by shuffle
        gone = F.broadcast(gone)
    return df.join(gone, df[doc_id] == gone[name], "left_anti")
