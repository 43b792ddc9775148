"""A corpus as token ids of a public byte-level BPE vocabulary.

The pieces of all texts are cut by one regular expression in the JVM; merging happens once
for each distinct piece, however rare. The ranks of the substrings a piece has are looked up
by a join with the rank table (whose size is that of the vocabulary) and kept by their
start, and a higher-order fold over the piece's byte boundaries takes the pair of lowest
rank, the leftmost of equal ones, until none is left. The ids are joined back to the pieces
of the documents and put together in their order. The most frequent pieces, a bounded
number, are broadcast for that, so the hot keys of the join move nothing; all others are
joined by shuffle. A fold takes time quadratic in a piece, so distinct pieces beyond
``fold_bytes`` (runs of one sign, mostly) are merged by a heap, once each, with the same
ids.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumenfold.session import cut

#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for Java, whose \s is ASCII only: Unicode white space is written out.
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
JAVA_PATTERN = PATTERN.replace(r"[^\s\p{L}", rf"[^{_SPACE}\p{{L}}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@dataclass(frozen=True)
class TokenParams:
    vocabulary: str = VOCABULARY  # path of a file with base64 pieces and ranks
    most_words: int = 200_000  # pieces that are broadcast, at most; the others are joined by shuffle
    fold_bytes: int = 512  # bytes of a piece up to which merges are folded in the JVM


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of every piece of the vocabulary."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}


def rank_table(spark: SparkSession, path: str) -> DataFrame:
    """(piece, rank): the vocabulary as a table."""
    ranks = read_ranks(path)
    return spark.createDataFrame(pa.table({"piece": pa.array(list(ranks), pa.binary()), "rank": pa.array(list(ranks.values()), pa.int32())}))


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: pairs of lowest rank first, the leftmost of equal ones, with a heap over a linked list."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    before = list(range(-1, n - 1))
    alive = bytearray(b"\x01") * n
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        rank, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone], end[i] = 0, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (p := before[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def pieces_of(text: str = "text"):
    """The pieces of a text in their order."""
    return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))


def distinct_pieces(documents: DataFrame) -> DataFrame:
    """(word, n): the pieces of all texts and how often they occur."""
    return documents.where("text is not null").select(F.explode(pieces_of()).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def frequent_pieces(pieces: DataFrame, most: int) -> DataFrame:
    """``pieces`` with ``hot``: whether a piece is among the most frequent, at most ``most``, whole classes of frequency from the top."""
    stored = cut(pieces.withColumn("class", F.floor(F.log2("n") * 64)))
    classes = stored.groupBy("class").agg(F.count("*").alias("k"))  # at most 64 for each power of two
    whole = Window.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    least = classes.withColumn("so_far", F.sum("k").over(whole)).where(F.col("so_far") <= most).agg(F.min("class")).first()[0]
    return stored.select("word", (F.col("class") >= (least if least is not None else 1 << 20)).alias("hot"))


def fold_merges(words: DataFrame, params: TokenParams = TokenParams()) -> DataFrame:
    """(word, ids): the ids of each distinct ``word`` of at most ``fold_bytes`` bytes, by a higher-order fold.

    The steps keep a partitioning by ``word``, so nothing is shuffled if ``words`` has it.
    """
    ranks = rank_table(words.sparkSession, params.vocabulary)
    longest = max(map(len, read_ranks(params.vocabulary)))
    coded = words.select("word", F.encode("word", "UTF-8").alias("b")).withColumn("size", F.octet_length("b")).where(F.col("size").between(1, params.fold_bytes))
    starts = coded.select("word", "size", "b", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("start"))
    spans = starts.select("word", "size", "b", "start", F.explode(F.sequence(F.lit(1), F.least(F.col("size") - F.col("start"), F.lit(longest)))).alias("len"))
    known = spans.withColumn("piece", F.substring("b", F.col("start") + 1, F.col("len"))).join(F.broadcast(ranks), "piece")  # a row for each entry of the vocabulary
    by_start = known.groupBy("word", "start").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("len", "rank"))).alias("r"))
    # each byte is a piece, so every start has a place; its ranks are few
    maps = by_start.groupBy("word").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("start", "r"))).alias("s")).select("word", "size", F.transform("s", lambda e: F.map_from_entries(e["r"])).alias("ranks"))
    no = F.lit(2**31 - 1)
    rank = lambda i, j: F.try_element_at(F.get(F.col("ranks"), i), j - i)  # noqa: E731  (of the bytes from i to j)

    def step(cuts, _):
        pairs = F.transform(F.sequence(F.lit(0), F.size(cuts) - 3), lambda t: F.coalesce(rank(F.get(cuts, t), F.get(cuts, t + 2)), no))
        best = F.array_min(pairs)
        at = F.array_position(pairs, best).cast("int")  # of the left part, from 1
        merged = F.concat(F.slice(cuts, F.lit(1), at), F.slice(cuts, at + 2, F.size(cuts)))
        return F.when(F.size(cuts) < 3, cuts).when(best == no, cuts).otherwise(merged)

    whole = rank(F.lit(0), F.col("size"))  # a piece that is an entry needs no merges
    folded = F.aggregate(F.sequence(F.lit(1), F.col("size")), F.sequence(F.lit(0), F.col("size")), step)
    cuts = F.when(whole.isNotNull(), F.array(F.lit(0), F.col("size"))).otherwise(folded)
    ids = F.transform(F.sequence(F.lit(0), F.size("cuts") - 2), lambda t: rank(F.get(F.col("cuts"), t), F.get(F.col("cuts"), t + 1)))
    return maps.withColumn("cuts", cuts).select("word", ids.alias("ids"))


def merge_long(words: DataFrame, params: TokenParams = TokenParams()) -> DataFrame:
    """(word, ids): the same for each distinct ``word`` of more than ``fold_bytes`` bytes, by a heap."""
    sent = words.sparkSession.sparkContext.broadcast(read_ranks(params.vocabulary))  # as many entries as the vocabulary has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [merge_bytes(w.encode(), sent.value) for w in batch.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").where(F.octet_length("word") > params.fold_bytes).mapInArrow(run, "word string, ids array<int>")


def encode(documents: DataFrame, params: TokenParams = TokenParams(), count_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns ``keep``, ids array<int>) or, with ``count_only``, n_tokens int in place of ids: one row for each row of ``documents``.

    No special tokens: their strings in a text are ordinary text. A null or empty text has
    an empty list. Other columns don't matter; rows of a repeated doc_id stay.
    """
    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # each text stays in one place while its pieces are exploded, looked up and put together again
    texts = cut(documents.select("doc_id", *keep, "text").withColumn("row", F.monotonically_increasing_id()))
    words = cut(frequent_pieces(distinct_pieces(texts), params.most_words).repartition(parts, "word"))
    merged = fold_merges(words, params).unionByName(merge_long(words, params))
    merged = cut(words.join(merged, "word").select("word", "hot", F.size("ids").alias("n") if count_only else "ids"))
    value = F.col("n") if count_only else F.struct("pos", "ids")
    gather = F.sum if count_only else F.collect_list
    placed = texts.where("text is not null").repartition(parts, "row").select("row", F.posexplode(pieces_of()).alias("pos", "word"))
    hot = F.broadcast(merged.where("hot").drop("hot"))  # at most most_words rows
    found = placed.join(hot, "word").groupBy("row").agg(gather(value).alias("found"))
    rare = merged.where(~F.col("hot")).drop("hot")
    if not rare.isEmpty():
        more = placed.join(hot, "word", "left_anti").join(rare, "word").groupBy("row").agg(gather(value).alias("more"))
        both = F.coalesce("found", F.lit(0)) + F.coalesce("more", F.lit(0)) if count_only else F.concat(*[F.coalesce(c, F.array().cast("array<struct<pos:int,ids:array<int>>>")) for c in ("found", "more")])
        found = found.join(more, "row", "full").select("row", both.alias("found"))
    whole = texts.select("row", "doc_id", *keep).join(found, "row", "left")
    if count_only:
        return whole.select("doc_id", *keep, F.coalesce("found", F.lit(0)).cast("int").alias("n_tokens"))
    ids = F.flatten(F.transform(F.array_sort("found"), lambda e: e["ids"]))
    return whole.select("doc_id", *keep, F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))


def decode(encoded: DataFrame, params: TokenParams = TokenParams()) -> DataFrame:
    """``encoded`` with ``text``: the pieces of its ``ids`` put together, all in the JVM; unknown ids and null lists give no text."""
    ranks = read_ranks(params.vocabulary)
    pieces = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece.hex()
    literal = F.from_json(F.lit(json.dumps(pieces)), T.ArrayType(T.StringType()))  # folded into one literal: lookups are by position
    return encoded.withColumn("text", F.decode(F.unhex(F.array_join(F.transform("ids", lambda i: F.get(literal, i)), "")), "UTF-8"))
