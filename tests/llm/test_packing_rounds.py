"""Packing keeps every piece, however many rounds it takes."""

from pyspark.sql import functions as F

from quillcount.llm import packing
from quillcount.llm.common import staged


def test_all_pieces_of_many_rounds(spark, monkeypatch):
    """Each of nine rounds halves the bins and leaves all of them underfull, in more than one block."""
    rounds = []

    def stub(round_, capacity):
        rounds.append(round_)
        pieces = 2 << round_

        def one(key, frame):
            at = frame.reset_index(drop=True).index
            return frame[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=(round_ << 56) | (int(key[0]) << 24) | (at // pieces), offset=at % pieces, fill=1)

        return one

    monkeypatch.setattr(packing, "_block_packer", stub)
    one = F.lit(1).cast("long")
    rows = spark.range(2_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), one.alias("length"), one.alias("ids_crc32"))
    out = packing.packed(staged(rows, "t"), block_pieces=500).collect()
    assert sorted(r.doc_id for r in out) == list(range(2_000))
    assert rounds == list(range(len(rounds))) and len(rounds) > 8
