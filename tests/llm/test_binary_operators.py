"""FLAC round trips and damage; training order against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import flac, training_order


def payloads():
    r = random.Random(4)
    return [bytes([7]) * 192, bytes(r.randrange(256) for _ in range(1920)), b" " * 383 + b"\xff", bytes(range(192)), bytes([0, 255] * 96) + b"a" * 960, np.random.default_rng(1).integers(0, 256, 192 * 150).astype(np.uint8).tobytes(), b"some plain text, again and again. " * 192]


def test_flac_round_trip_and_damage():
    data = payloads()
    streams = flac.encode_many(data)
    assert flac.decode_many(streams) == data
    assert [flac.decode_many([s]) for s in streams] == [[d] for d in data]
    assert [flac.encode_many([d])[0] for d in data] == streams  # a stream doesn't depend on its batch
    for at in (-3, -60, 60 + 30):
        bad = bytearray(streams[5])
        bad[at] ^= 0x10
        with pytest.raises(ValueError):
            flac.decode_many([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode_many([b"RIFF" + streams[0][4:]])


def test_frame_checksums_by_definition():
    stream = flac.encode_many([b"x" * 150 + b"yz" * 21])[0]
    frame = stream[4 + 4 + 34 + 4 + 18 :]

    def crc(data, poly, width):
        value = 0
        for byte in data:
            value ^= byte << (width - 8)
            for _ in range(8):
                value = (value << 1 ^ poly if value >> (width - 1) else value << 1) & ((1 << width) - 1)
        return value

    assert frame[:2] == b"\xff\xf8" and crc(frame[:5], 0x07, 8) == frame[5]
    assert crc(frame[:-2], 0x8005, 16) == int.from_bytes(frame[-2:])


def test_flac_tables(spark):
    rows = [(1, "hello"), (2, None), (3, ""), (4, "é" * 500), (4, "é" * 500), (None, "x"), (5, "long text " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("other"))
    media = flac.encode(df)
    out = flac.digest(media).collect()
    expected = collections.Counter()
    for i, t in rows:
        raw = (t or "").encode()
        full = flac.pad(raw)
        assert len(full) % 192 == 0 and len(full) > 0
        expected[i, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:])] += 1
    assert collections.Counter((o.doc_id, o.n_bytes, o.payload_bytes, o.payload_sha256, o.tail_crc32) for o in out) == expected
    blocks = flac.decode(media.filter("doc_id = 5"), samples=1920).orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == flac.pad(rows[-1][1].encode()) and all(b.sample_offset % 1920 == 0 for b in blocks)
    assert flac.digest(flac.encode(df.limit(0))).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        assert sorted(training_order.permute(np.arange(n), n, 7).tolist()) == list(range(n))
    assert training_order.permute(np.arange(50), 50, 1).tolist() != training_order.permute(np.arange(50), 50, 2).tolist()


def test_training_order(spark, tmp_path):
    r = random.Random(6)
    rows = [(i, "".join(r.choice("abc é") for _ in range(r.randint(0, 300)))) for i in range(80)] + [(200, None), (201, ""), (None, "lost"), (5, "again"), (202, "w" * 9000)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path).withColumn("slot", F.lit("other"))
    folder = str(tmp_path / "shards")
    index = training_order.materialise(df, folder, length=64, per_shard=10).orderBy("slot").collect()
    stored = df.select("doc_id", "text").collect()
    stream = b"".join((s.text or "").encode() + b"\xff" for s in stored)
    n = -(-len(stream) // 64)
    full = stream + b"\xfe" * (n * 64 - len(stream))
    slots = training_order.permute(np.arange(n), n, 20240101).tolist()
    want = {slots[k]: full[k * 64 : (k + 1) * 64] for k in range(n)}
    assert [i.slot for i in index] == list(range(n))
    assert all(hashlib.sha256(want[i.slot]).hexdigest() == i.tokens_sha256 for i in index)
    assert list(training_order.read_slots(folder, 7, 25, 64, 10)) == [want[k] for k in range(7, 32)]
    assert sum(i.n_tokens for i in index) == len(stream) and all((i.shard, i.byte_offset) == (i.slot // 10, i.slot % 10 * 64) for i in index)
    again = training_order.materialise(df, folder, length=64, per_shard=10).orderBy("slot").collect()
    assert again == index
    assert training_order.materialise(df.limit(0), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize(("vocabulary", "width"), [(50_000, 2), (65_534, 2), (65_535, 4)])
def test_training_order_of_token_ids(spark, tmp_path, vocabulary, width):
    r = random.Random(vocabulary)
    lists = [[r.randrange(vocabulary) for _ in range(r.choice([0, 3, 40, 200]))] for _ in range(70)] + [[0, 254, 255, 256, vocabulary - 1], None]
    df = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>").repartitionByRange(3, "doc_id")
    folder = str(tmp_path / "ids")
    index = training_order.materialise(df, folder, length=64, per_shard=10, ids="ids", vocabulary=vocabulary).orderBy("slot").collect()
    end, fill = 256**width - 1, 256**width - 2
    stream = [t for row in df.collect() for t in [*(row.ids or []), end]]
    n = -(-len(stream) // 64)
    full = np.array(stream + [fill] * (n * 64 - len(stream)), f"<u{width}")
    slots = training_order.permute(np.arange(n), n, 20240101).tolist()
    want = {slots[k]: full[k * 64 : (k + 1) * 64].tobytes() for k in range(n)}
    assert list(training_order.read_slots(folder, 0, n, 64, 10, width)) == [want[k] for k in range(n)]
    assert [i.tokens_sha256 for i in index] == [hashlib.sha256(want[k]).hexdigest() for k in range(n)]
    assert sum(i.n_tokens for i in index) == len(stream) and all(i.byte_offset == i.slot % 10 * 64 * width for i in index)


def test_training_order_does_not_hang_on_splits(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abc é") for _ in range(r.randint(0, 400)))) for i in range(900)] + [(5, "again"), (None, None)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.option("parquet.block.size", 4096).parquet(path)
    made = []
    for k, most in enumerate(("128m", "16k", "5k")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        try:
            df = spark.read.parquet(path).select("doc_id", "text", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"))
            made.append((df.rdd.getNumPartitions(), training_order.materialise(df, str(tmp_path / f"s{k}"), length=64, per_shard=10, order=("f", "r"), per_task=k + 1).orderBy("slot").collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len({n for n, _ in made}) > 1 and made[0][1] == made[1][1] == made[2][1]


def test_training_order_refuses_ids_outside_the_vocabulary(spark, tmp_path):
    for bad in ([3, 100], [-1], [1, None]):
        df = spark.createDataFrame([(1, bad)], "doc_id long, ids array<int>")
        with pytest.raises(Exception, match="ids"):
            training_order.materialise(df, str(tmp_path / "bad"), ids="ids", vocabulary=100).collect()


def test_training_order_query_writes_the_ids_of_bpe(spark, tmp_path):
    import public_tokenizers
    from tidemark.llm import bpe, queries

    rows = [(i, "the river été stone " * (i % 5), "en", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    index = queries.op4_training_order(spark, str(tmp_path)).collect()
    codec = bpe.encode(spark.read.parquet(str(tmp_path / "documents.parquet")), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sum(i.n_tokens for i in index) == sum(len(x.ids) + 1 for x in codec.collect())
