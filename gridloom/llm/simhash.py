"""Near-duplicate documents by SimHash, with candidates from pigeonring filtering.

A fingerprint is cut into m = 2t + 1 segments in a ring, where links differ in at most t bits. The differing bits of
a link, dealt over m segments, leave some start from which every chain of l segments differs in at most floor(l t / m)
bits: none in the first two segments. So

1. each distinct fingerprint goes to m buckets, by a start and the values of the two segments there;
2. a bucket of more than ``bucket_rows`` is dealt on: of the bits not yet fixed, cut into t + 1 parts, one part must agree;
   so its rows go to t + 1 smaller buckets by the value of a part, again and again until buckets are small enough. No
   row is left out: when the bits left can't tell more than ``bucket_rows`` rows apart, the bucket is small;
3. within a bucket, pairs are held against the chain's budgets segment by segment, and those left against the full
   Hamming distance. A bucket gives the links of a spanning forest, so at most one link fewer than its rows;
4. the links' connected components are the groups.

Pairs are told apart inside a task over at most ``bucket_rows`` rows; no join makes them. Copies share a fingerprint and
count once. What the driver holds is one row of counts a round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.components import components
from gridloom.llm.keeping import join_by_key, least_of_each, numbered
from gridloom.llm.scratch import Scratch

BITS = 64
#: Shingles whose bits are counted at once.
AT_ONCE = 16_384


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a text: A-Z lower-cased, words split at ASCII white space, shingles of ``words`` words.

    A bit is 1 if set in more than half the shingles' XXH64, repeats included. Fewer words: one shingle of them all. No
    word: 0.
    """
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return 0
    if len(found) < words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed)
    line, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(found) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist())
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in spans), np.uint64, n)
    return of_hashes(hashes)


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of unsigned 64-bit hashes: the bits set in more than half of them; 0 of none."""
    counts = np.zeros(BITS, np.int64)
    for low in range(0, len(hashes), AT_ONCE):
        counts += np.unpackbits(hashes[low : low + AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py() or "", words, seed) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _segments(parts: int, bits: list[int]) -> list[int]:
    """Masks of ``parts`` runs, as even as can be, of the bits with these numbers."""
    return [sum(1 << int(b) for b in run) for run in np.array_split(np.asarray(bits, np.int64), parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bits(mask: int) -> list[int]:
    return [b for b in range(BITS) if mask >> b & 1]


def _forest(fps: np.ndarray, masks: list[int], most: int) -> list[tuple[int, int]]:
    """Links of a spanning forest among fingerprints; masks: the ring's segments from where the bucket's chain starts."""
    n, m = len(fps), len(masks)
    left, right = np.triu_indices(n, 1)
    differ = fps[left] ^ fps[right]
    chain = np.zeros(len(differ), np.int64)
    for length, mask in enumerate(masks, 1):
        chain += np.bitwise_count(differ & np.uint64(mask))
        keep = chain <= length * most // m
        left, right, differ, chain = left[keep], right[keep], differ[keep], chain[keep]
    keep = np.bitwise_count(differ) <= most
    root, found = list(range(n)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in zip(left[keep].tolist(), right[keep].tolist()):
        if (x := top(a)) != (y := top(b)):
            root[max(x, y)] = min(x, y)
            found.append((a, b))
    return found


def links(distinct: DataFrame, scratch: Scratch, most: int = 2, bucket_rows: int = 128) -> DataFrame:
    """Links (a, b) that join all fingerprints at most ``most`` bits apart, through others where need be.

    distinct: a written table with a column fp, without repeats or nulls.
    """
    ring = _segments(2 * most + 1, list(range(BITS)))
    around = [ring[i:] + ring[:i] for i in range(len(ring))]
    spark = distinct.sparkSession
    # a way is a start in the ring and the bits fixed so far
    ways = [(start, masks[0] | masks[1]) for start, masks in enumerate(around)]
    rows, level, found = distinct.select("fp"), 0, []
    dealt = rows.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("way"), F.col("fp").bitwiseAND(F.lit(_signed(fixed))).alias("key")) for n, (_, fixed) in enumerate(ways)])).alias("x")).select("fp", "x.way", "x.key")

    while True:
        dealt = scratch.keep(dealt, f"dealt{level}")
        sizes = dealt.groupBy("way", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
        sized = dealt.join(sizes, ["way", "key"])
        small = sized.filter(F.col("n") <= bucket_rows).select("way", "key", "fp")

        def run(batches: Iterator[pa.RecordBatch], ways: list[tuple[int, int]] = ways) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []

            def told(table: np.ndarray) -> pa.RecordBatch:
                cuts = np.flatnonzero(np.any(table[1:, :2] != table[:-1, :2], axis=1)) + 1
                pairs = []
                for part in np.split(table, cuts):
                    fps = part[:, 2].view(np.uint64)
                    pairs += [(int(part[a, 2]), int(part[b, 2])) for a, b in _forest(fps, around[ways[part[0, 0]][0]], most)]
                columns = list(zip(*pairs)) if pairs else [[], []]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

            for batch in batches:
                if not batch.num_rows:
                    continue
                table = np.column_stack([batch.column(i).to_numpy() for i in range(3)]).astype(np.int64)
                table = np.concatenate([*held, table])
                last = int(np.flatnonzero(np.any(table[:, :2] != table[-1, :2], axis=1))[-1] + 1) if np.any(table[:, :2] != table[-1, :2]) else 0
                held = [table[last:]]  # the last bucket may go on in the next batch
                if last:
                    yield told(table[:last])
            if held and len(held[0]):
                yield told(held[0])

        together = small.repartition("way", "key").sortWithinPartitions("way", "key", "fp")
        found.append(scratch.keep(together.mapInArrow(run, "a long, b long"), f"found{level}"))
        large = scratch.keep(sized.filter(F.col("n") > bucket_rows).select("way", "fp"), f"large{level}")
        scratch.drop(f"dealt{level}")
        used = {r["way"] for r in large.select("way").distinct().collect()}  # at most (t + 1) times as many as a level before
        if not used:
            break
        level, more, onward = level + 1, [], {}
        for way in sorted(used):
            start, fixed = ways[way]
            onward[way] = []
            for mask in _segments(most + 1, _bits(~fixed & (1 << 64) - 1)):
                onward[way].append(len(more))
                more.append((start, fixed | mask))
        ways = more
        choices = F.create_map(*[x for way, to in onward.items() for x in (F.lit(way), F.array(*[F.struct(F.lit(n).alias("way"), F.lit(_signed(ways[n][1])).alias("mask")) for n in to]))])
        dealt = large.select("fp", F.explode(choices[F.col("way")]).alias("x")).select("fp", "x.way", F.col("fp").bitwiseAND(F.col("x.mask")).alias("key"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 2, seed: int = 42, bucket_rows: int = 128) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable, of every row.

    Fingerprints at most ``most`` bits apart are linked, equal ones too. A null or empty text has fingerprint zero, and is
    linked like any other. Repeated rows are kept, in one component. A null doc_id never names a component; a component
    of null doc_ids alone has a null component_id. An empty table gives an empty table. Other columns aren't read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs, words, seed), "prints")
    distinct = scratch.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = scratch.keep(components(links(distinct, scratch, most, bucket_rows), scratch), "roots")
    rooted = roots.join(distinct, roots["node"] == distinct["fp"])
    named = rooted.groupBy("root").agg(F.min("least").alias("named"))
    linked = roots.join(named, "root").select(F.col("node").alias("fp"), "named")
    groups = scratch.keep(distinct.join(linked, "fp", "left").select("fp", F.coalesce("named", "least").alias("component_id"), "n"), "groups")
    return join_by_key(prints, groups, "fp", "n").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 3, most: int = 2, seed: int = 42, bucket_rows: int = 128) -> DataFrame:
    """One row of docs for each group of near duplicates, that with the smallest doc_id, as it is.

    Of rows repeated under a doc_id one stays in each group that it names. Rows without a doc_id all stay.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    rows, rid = numbered(docs, scratch)
    # with row numbers for doc_ids, a component's name is its own even where doc_ids repeat
    groups = near_duplicates(rows.select(F.col(rid).alias("doc_id"), "text"), words, most, seed, bucket_rows)
    return least_of_each(rows, rid, groups.select(F.col("doc_id").alias(rid), F.col("component_id").alias("component")), scratch)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component: 3-word shingles, links at 2 or fewer differing bits."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
