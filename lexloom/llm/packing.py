"""Problem 6: filling containers of fixed capacity, with a controlled mixture of sources.

Texts are measured in tokens of a public tokenizer. Every source has a target share of the tokens, by default the one it has
in the corpus. The order in which a fair server would hand over the texts at these shares follows from running token sums
alone: a text stands at the number of tokens its source has before it, divided by the source's share. This order is cut into
shards of about ``SHARD_TOKENS``, so that every shard holds every source at its target share, to within one text, as long as
the source lasts; what a text hangs over the edge of its shard is debited from its source in the next one. So deficits are
carried over partitions exactly, although no shard waits for another.

In a shard the sources are queues and a deficit round-robin serves them window by window: every round credits a source with
its share, a source hands over texts as long as its credit lasts, and what is left is carried into the next window. The texts
of a window go into the containers, longest first and each into the fullest container that still takes it; containers with
room stay open for later windows. Only texts larger than a container are split, into full containers and one remainder, each
served and debited like a text.

Defined cases: null and empty texts hold no tokens and are not packed; a null source is a source of its own (``''``); a capacity
that is null or below one is no container; repeated rows are packed as often as they occur; very long texts are measured
whole; a source that is exhausted leaves its share to the others; sources without a target share what the others leave, in
proportion to their size, and come last if nothing is left.
"""

from __future__ import annotations

import base64
import os
from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

TOKENIZER_DIR, RANKS = os.environ.get("LEXLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_multi_50k.tiktoken"
#: Tokens of a shard; containers a window fills at least, texts a window holds at least, rounds of a window.
SHARD_TOKENS, WINDOW_CONTAINERS, WINDOW_TEXTS, ROUNDS = 2_000_000, 32, 400, 8
#: What sources without a target get where the targets leave nothing: they come after all others.
LAST_SHARE = 1e-9
#: Buckets whose token sums are added up in one task.
BUCKETS_A_GROUP = 4096
CACHE_WORDS = 500_000

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenCounter(dict):
    """Token counts of texts; merges never cross the pieces of the pattern, so each piece is encoded once."""

    def __init__(self, folder: str = TOKENIZER_DIR, ranks: str = RANKS):
        import regex
        import tiktoken

        sent = SparkFiles.get(ranks)  # what :func:`measured` sent to the executors, if it could
        with open(sent if os.path.exists(sent) else os.path.join(folder, ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = regex.compile(PATTERN).findall
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(piece))
        if len(piece) < 64:
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        return sum(map(self.__getitem__, self.pieces(text)))


def measured(docs: DataFrame, key: str, text: str, source: str, folder: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """(``k``, ``source``, ``n``): the size of every text in tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(folder, ranks)
        for batch in batches:
            n = [counter.count(t) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["k", "source", "n"])

    path = os.path.join(folder, ranks)
    if os.path.exists(path):
        docs.sparkSession.sparkContext.addFile(path)  # executors need not have the folder
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.col(text).alias("t"))
    return rows.mapInArrow(count, "k long, source string, n long").where("n > 0")


class _Open:
    """Open containers by free room."""

    def __init__(self, capacity: int):
        self.capacity, self.free, self.n = capacity, [], 0

    def put(self, size: int) -> int:
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, box = self.free.pop(at)
        else:
            room, box = self.capacity, self.new()
        if room > size:
            insort(self.free, (room - size, box))
        return box

    def new(self) -> int:
        self.n += 1
        return self.n - 1


def pack_shard(
    items: list[tuple[int, str, int]], capacity: int, shares: dict[str, float], credit: dict[str, float]
) -> tuple[list[tuple], dict[str, float]]:
    """One shard's texts in one capacity, each source's in the order given: [(place of the text in ``items``, piece, first
    token, tokens, container, window)] and what is left of each source's credit at the end."""
    if capacity < 1:
        raise ValueError("capacity must be positive")
    boxes, out = _Open(capacity), []
    queues: dict[str, deque] = {}
    tokens = pieces = 0
    for at, (_, source, n) in enumerate(items):
        if n > 0:
            queues.setdefault(source, deque()).append((at, n))
            tokens, pieces = tokens + n, pieces + -(-n // capacity)
    deficit = {s: credit.get(s, 0.0) for s in queues}
    if not tokens:
        return out, deficit
    budget = max(WINDOW_CONTAINERS * capacity, int(WINDOW_TEXTS * tokens / pieces))
    done = dict.fromkeys(queues, 0)  # tokens of a source's first text that are served
    window, left = 0, tokens
    live = list(queues)
    while live:
        chosen, size = [], 0
        while live and (size < budget or left < budget / 2):  # a rest too small for a window of its own joins the last one
            total = sum(shares[s] for s in live)
            for s in live:
                deficit[s] += budget / ROUNDS * shares[s] / total
                q = queues[s]
                while q:
                    at, n = q[0]
                    start = done[s]
                    part = min(capacity, n - start)
                    if part > deficit[s]:
                        break
                    chosen.append((part, at, start // capacity, start))
                    deficit[s] -= part
                    size += part
                    left -= part
                    done[s] = start + part
                    if done[s] == n:
                        q.popleft()
                        done[s] = 0
            live = [s for s in live if queues[s]]
        chosen.sort(key=lambda x: (-x[0], x[1]))
        for n, at, piece, start in chosen:
            out.append((at, piece, start, n, boxes.put(n), window))
        window += 1
    return out, deficit


PACKED = (
    "container_kind string, capacity_tokens int, container_id string, doc_id long, source string, piece int, first_token long, "
    "n_tokens int, shard long, pack_window int"
)


class Mixture:
    """Target shares of sources, and the order in which a fair server hands their tokens over.

    At ``time`` t every source has handed over its share times t tokens, until it has no more. Named sources have their own
    entry, all others together one, since shares in proportion to their sizes exhaust them at the same time; so this is as
    large as the targets that are given.
    """

    def __init__(self, targets: dict[str, float] | None, sizes: dict[str, int], total: int):
        self.named = {s: float(t) for s, t in (targets or {}).items() if t > 0 and sizes.get(s)}
        if sum(self.named.values()) > 1 + 1e-9:
            raise ValueError("target shares exceed 1")
        self.others = total - sum(sizes[s] for s in self.named)  # tokens of all sources without a target
        self.rest = max(LAST_SHARE, 1.0 - sum(self.named.values()))
        self.ends = [(sizes[s], t) for s, t in self.named.items()] + ([(self.others, self.rest)] if self.others > 0 else [])

    def share(self, source: Column, size: Column) -> Column:
        """The share of a source of this size."""
        rest = F.lit(self.rest) * size / F.lit(float(max(1, self.others)))
        if not self.named:
            return rest
        return F.coalesce(F.create_map(*[F.lit(x) for kv in self.named.items() for x in kv])[source], rest)

    def served(self, time: Column) -> Column:
        """Tokens handed over by all sources together at a time."""
        if not self.ends:
            return F.lit(0.0)
        ends = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(t).alias("t")) for a, t in self.ends])
        return F.aggregate(ends, F.lit(0.0), lambda sum_, x: sum_ + F.least(x["a"], x["t"] * time))

    def time(self, served: float) -> float:
        """When so many tokens are handed over."""
        at, before = 0.0, 0.0
        ends = sorted((a / t, a, t) for a, t in self.ends)
        speed = sum(t for _, _, t in ends)
        for end, _, t in ends:
            if before + speed * (end - at) >= served:
                break
            before, at, speed = before + speed * (end - at), end, speed - t
        return at + (served - before) / speed if speed > 1e-15 else at


def running(rows: DataFrame, source: str, bucket: str, n: str) -> DataFrame:
    """``rows`` (one a source and bucket) with ``before``: the sum of ``n`` in the source's buckets before; added up in groups,
    so that no task sees more than ``BUCKETS_A_GROUP`` buckets or one sum a group."""
    group = F.floor(F.col(bucket) / BUCKETS_A_GROUP).alias("_group")
    before = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = rows.select("*", group).withColumn("_inside", before(W.partitionBy(source, "_group").orderBy(bucket)))
    groups = rows.select(source, n, group).groupBy(source, "_group").agg(F.sum(n).alias(n))
    outside = groups.select(F.col(source).alias("_s"), F.col("_group").alias("_g"), before(W.partitionBy(source).orderBy("_group")).alias("_outside"))
    return inside.join(outside, (F.col(source) == F.col("_s")) & (F.col("_group") == F.col("_g"))).select(
        *rows.columns, (F.col("_inside") + F.col("_outside")).alias("before")
    )


def sharded(sizes: DataFrame, targets: dict[str, float] | None = None) -> tuple[DataFrame, Mixture, int, float]:
    """((``k``, ``source``, ``n``, ``share``, ``place``, ``shard``), mixture, number of shards, tokens of a shard): every text with its
    place in its source's queue, in tokens, and its shard."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    named = list(targets or ())
    known = sizes.where(F.col("source").isin(named)).groupBy("source").agg(F.sum("n")).collect() if named else []
    mixture = Mixture(targets, {r[0]: r[1] for r in known}, total)
    n_shards = max(1, -(-total // SHARD_TOKENS))
    step = max(1.0, total / n_shards)
    bucket = F.pmod(F.xxhash64("k"), F.lit(n_shards)).alias("bucket")
    sums = sizes.select("source", bucket, "n").groupBy("source", "bucket").agg(F.sum("n").alias("bucket_n"))
    sources = sums.groupBy("source").agg(F.sum("bucket_n").alias("size"))
    shares = sources.select("source", mixture.share(F.col("source"), F.col("size").cast("double")).alias("share"))
    starts = running(sums, "source", "bucket", "bucket_n").join(shares, "source").drop("bucket_n")
    inside = F.sum("n").over(W.partitionBy("source", "bucket").orderBy("k", "n").rowsBetween(W.unboundedPreceding, -1))
    placed = (
        sizes.select("k", "source", "n", bucket)
        .withColumn("inside", F.coalesce(inside, F.lit(0)))  # a source's texts in a bucket: about a shard's worth at most
        .join(starts, ["source", "bucket"])
        .withColumn("place", F.col("before") + F.col("inside"))
    )
    # a fixed part of each text sets the source's phase: small sources would else all stand at the very start
    phase = F.pmod(F.xxhash64(F.lit(7), "source"), F.lit(1024)) / F.lit(1024.0)
    served = mixture.served((F.col("place") + phase * F.col("n")) / F.col("share"))
    shard = F.least(F.floor(served / F.lit(step)), F.lit(n_shards - 1)).cast("long")
    return placed.select("k", "source", "n", "share", "place", shard.alias("shard")), mixture, n_shards, step


def pack(
    docs: DataFrame, containers: DataFrame, key: str, text: str, source: str, materialize, targets: dict[str, float] | None = None
) -> DataFrame:
    """Every text's containers: ``PACKED``; one row a piece, one piece for every text that fits its container.

    ``targets`` gives shares of tokens by source (together at most 1), by default those of the corpus.
    """
    kinds = [(r[0], r[1]) for r in containers.select("container_kind", "capacity_tokens").distinct().collect() if r[1] and r[1] > 0]
    sizes = materialize(measured(docs, key, text, source), "tokens")
    work, mixture, n_shards, step = sharded(sizes, targets)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["source", "place"], kind="stable")
        shard = int(pdf["shard"].iloc[0])
        items = list(zip(pdf["k"].tolist(), pdf["source"].tolist(), pdf["n"].tolist()))
        one = pdf.drop_duplicates("source")
        share = dict(zip(one["source"], one["share"]))
        # what the source should have handed over before this shard, less what it has
        begin = mixture.time(shard * step)
        credit = {s: share[s] * begin - place for s, place in zip(one["source"], one["place"])}
        keys, sources = pdf["k"].to_numpy(), pdf["source"].to_numpy()
        parts = []
        for kind, capacity in kinds:
            rows, _ = pack_shard(items, capacity, share, credit)
            part = pd.DataFrame(rows, columns=["at", "piece", "first_token", "n_tokens", "box", "pack_window"])
            part["doc_id"], part["source"] = keys[part["at"].to_numpy(dtype=int)], sources[part["at"].to_numpy(dtype=int)]
            part["container_kind"], part["capacity_tokens"], part["shard"] = kind, capacity, shard
            part["container_id"] = [f"{kind}-{shard}-{b}" for b in part["box"].tolist()]
            parts.append(part.drop(columns=["at", "box"]))
        names = [c.split()[0] for c in PACKED.split(", ")]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)

    # a number of partitions of its own keeps small shards from being put together in one task
    return work.repartition(min(n_shards, 100_000), "shard").groupBy("shard").applyInPandas(fill, PACKED)


def mixtures(packed: DataFrame) -> DataFrame:
    """(``container_kind``, ``capacity_tokens``, ``shard``, ``pack_window``, ``source``, ``n_tokens``, ``window_tokens``, ``share``): what
    each source has of each window."""
    keys = ["container_kind", "capacity_tokens", "shard", "pack_window"]
    by = packed.groupBy(*keys, "source").agg(F.sum("n_tokens").alias("n_tokens"))
    windows = F.sum("n_tokens").over(W.partitionBy(*keys))  # one row a source
    return by.withColumn("window_tokens", windows).withColumn("share", F.round(F.col("n_tokens") / F.col("window_tokens"), 6))


def fills(packed: DataFrame) -> DataFrame:
    """(``container_kind``, ``capacity_tokens``, ``container_id``, ``n_docs``, ``used_tokens``, ``fill``)."""
    return packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_tokens").alias("used_tokens"),
        F.round(F.sum("n_tokens") / F.first("capacity_tokens"), 6).alias("fill"),
    )
