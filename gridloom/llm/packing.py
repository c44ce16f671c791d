"""Best-fit packing of documents into token sequences, certified by dual-feasible-function bounds.

1. Each text is turned into token ids, and cut into pieces of at most ``capacity`` tokens (``pieces``).
2. Pieces are dealt over partitions. Each partition packs its own by best-fit decreasing, and takes a lower bound on its
   bin count from dual feasible functions of its piece lengths. Equal: the partition is certified, no packing of its
   pieces alone needs fewer.
3. The same bound over all pieces, from their counts by length, certifies the whole. Until it is met, bins with a gap
   change places as wholes: they are dealt anew over an eighth of the partitions, and their pieces packed again. A
   partition keeps the bins it was given unless the new ones are fewer. This ends with one partition of at most about
   ``partition_rows`` pieces, or where a round of as many partitions saves less than one bin in a thousand.

Memory: a partition holds the lengths and row numbers of about ``partition_rows`` pieces; the driver holds one row of
counts a round, and one count for each length up to ``capacity``.
"""

from __future__ import annotations

import base64
import logging
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.scratch import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoding(path: str) -> Callable[[str], list[int]]:
    """Text to ids by a ``tokenizers`` file; special tokens' strings in a text are ordinary text.

    Where the rank file of the same vocabulary lies beside it, that is run: both give the same ids (tests hold them
    against each other), and its library is several times faster.
    """
    ranks = re.sub(r"\.json$", ".tiktoken", path)
    if os.path.exists(ranks):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """The pieces of each document: ids of its whole text, then end_id, cut so that only the first piece may be shorter.

    Returns doc_id, piece (from 0), start (ids of the document before it), length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers). A null text counts as empty: one piece that holds end_id alone. A repeated row, or a
    null doc_id, gives pieces of its own. Other columns are not read.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                total, data = len(ids), ids.tobytes()
                first = (total - 1) % capacity + 1
                at = [0, *range(first, total, capacity), total]
                rows += [(doc_id, n, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for n, (a, b) in enumerate(zip(at, at[1:]))]
            columns = zip(*rows) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and what each bin holds."""
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    held: list[int] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: some bin has a gap of g
    for row in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[row])
        fits = gaps >> length
        if fits:
            gap = length + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
        else:
            gap, b = capacity, len(held)
            held.append(0)
        bin_of[row], offset[row] = b, held[b]
        held[b] += length
        by_gap[gap - length].append(b)
        gaps |= 1 << (gap - length)
    return bin_of, offset, np.asarray(held, np.int64)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """``least_bins_of`` for the lengths themselves."""
    return least_bins_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def least_bins_of(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins that counts[x] lengths of x need, from two families of dual feasible functions.

    For a cut e up to half the capacity: lengths over capacity - e count as full, those under e as nothing. For k from 1
    to 20: x counts as floor((k + 1) x) / k, or as x where (k + 1) x is whole (x as a part of the capacity).
    """
    counts = counts.astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    number, volume = np.cumsum(counts), np.cumsum(counts * size)
    cut = np.arange(1, capacity // 2 + 1)
    below = np.where(cut > 0, volume[cut - 1], 0)
    best = int(np.max((number[-1] - number[capacity - cut]) * capacity + volume[capacity - cut] - below, initial=volume[-1]))
    bound = -(-best // capacity)
    for k in range(1, 21):
        whole = (k + 1) * size % capacity == 0
        scaled = np.where(whole, size * k, (k + 1) * size // capacity * capacity)  # capacity * k is 1
        bound = max(bound, -(-int((scaled * counts).sum()) // (capacity * k)))
    return bound


def _packer(turn: int, capacity: int, columns: list[str]):
    """The work on one partition in one round: its pieces with their bins, and which of them are open to another round."""

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_numpy()
        bins, offset, held = best_fit_decreasing(lengths, capacity)
        ids = (turn << 56) + (key[0].as_py() << 28) + bins
        if turn:
            before, of = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
            if len(held) >= len(before):
                held = np.bincount(of, lengths).astype(np.int64)
                ids, offset, bins = before[of], table.column("offset").to_numpy(), of
        certified = len(held) == least_bins(lengths, capacity)  # then it lets go only the larger gaps
        opened = (capacity - held > capacity // (32 if certified else 64))[bins]
        table = table.select(columns)
        for name, values in (("sequence_id", ids), ("offset", offset), ("open", opened)):
            table = table.append_column(name, pa.array(values))
        return table

    return packed


def pack(cut: DataFrame, scratch: Scratch, capacity: int = 1024, partition_rows: int = 65_536) -> DataFrame:
    """Pieces with sequence_id and offset: sequences of at most ``capacity``, gapless from 0.

    cut: a written table of pieces with a long column ``rid`` that no two rows share. Whole pieces are sequences by
    themselves. An empty table gives an empty table.
    """
    spark = cut.sparkSession
    columns = [c for c in cut.columns if c != "rid"]
    done = [cut.filter(F.col("length") >= capacity).select(*columns, (-1 - F.col("rid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    pool = cut.filter(F.col("length") < capacity)
    counts = np.zeros(capacity + 1, np.int64)
    for r in pool.groupBy("length").count().collect():  # at most capacity - 1 rows
        counts[r["length"]] = r["count"]
    rows, fewest, was = int(counts.sum()), least_bins_of(counts, capacity), 0
    parts = max(-(-rows // partition_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    schema = f"{cut.schema.simpleString()[7:-1]}, sequence_id long, offset long, open boolean"
    closed, saved, turn = 0, True, 0
    while rows and saved:
        deal = F.pmod(F.xxhash64(F.col("sequence_id" if turn else "rid"), F.lit(turn)), F.lit(parts))
        now = scratch.keep(pool.groupBy(deal.alias("part")).applyInArrow(_packer(turn, capacity, cut.columns), schema), f"round{turn}")
        first = F.col("offset") == 0  # one piece of each bin
        count = now.agg(F.count_if(first).alias("bins"), F.count_if(first & F.col("open")).alias("open"), F.count_if("open").alias("rows")).first()
        rows, fewer = count["rows"], max(1, -(-count["rows"] // partition_rows), parts // 8)
        saved = closed + count["bins"] > fewest and (fewer < parts or (parts > 1 and (turn == 0 or count["bins"] < was - was // 1000)))
        if not saved:
            done.append(now.select(*columns, "sequence_id", "offset"))
            break
        done.append(now.filter(~F.col("open")).select(*columns, "sequence_id", "offset"))
        pool, was = now.filter("open"), count["open"]
        closed, parts, turn = closed + count["bins"] - count["open"], fewer, turn + 1
    logging.getLogger(__name__).info("cut pieces: at most %d sequences, at least %d needed, after %d rounds", closed + (0 if saved else count["bins"]) if counts.sum() else 0, fewest, turn + 1)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    cut = pieces(docs, tokenizer, capacity, end_id).withColumn("rid", F.monotonically_increasing_id())
    return pack(scratch.keep(cut, "pieces"), scratch, capacity)


def certificate(packed: DataFrame, capacity: int = 1024) -> DataFrame:
    """One row: sequences, least (what any packing of these pieces needs, by the dual feasible functions) and gap, the difference.

    What the driver holds is a count for each length.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():  # at most capacity rows
        counts[r["length"]] = r["count"]
    least = int(counts[capacity]) + least_bins_of(np.where(np.arange(capacity + 1) < capacity, counts, 0), capacity)
    return packed.agg(F.count_distinct("sequence_id").alias("sequences")).select("sequences", F.lit(least).cast("long").alias("least"), (F.col("sequences") - least).alias("gap"))


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
