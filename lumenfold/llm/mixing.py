"""Sources mixed to target weights by weighted fair queueing.

Every copy of a document gets the virtual time at which a fair queue would have sent its last
token: the tokens of its source up to and including it, divided by the source's weight. The
mixture is what comes first in virtual time, up to a budget. Running sums are two-level: a
source's shuffled documents fall into buckets of a hash, whose sums make a small table of
prefixes, and a window runs within one bucket only; so a source with a third of all rows is no
single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumenfold.llm.tokens import TokenParams, encode
from lumenfold.session import cut


def normal_source(source: Column) -> Column:
    """A source's name without white space around it, in lower case."""
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def running_sum(rows: DataFrame, value: str, by: list[str], order: list[Column], bucket: Column, out: str) -> DataFrame:
    """``rows`` with ``out``, the sum of ``value`` up to each row in (bucket, order) within ``by``.

    ``bucket`` must rise with the order, and no bucket hold more rows than a task can sort.
    """
    marked = rows.withColumn("__b", bucket)
    sums = marked.groupBy(*by, "__b").agg(F.sum(value).alias("__s"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__s").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__s")
    inside = Window.partitionBy(*by, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return marked.join(before, [*by, "__b"]).withColumn(out, F.sum(value).over(inside) + F.col("__before")).drop("__b", "__before")


def virtual_times(documents: DataFrame, targets: DataFrame, params: TokenParams = TokenParams(), seed: int = 17, bucket_rows: int = 50_000) -> DataFrame:
    """(doc_id, source, copy, n_tokens, source_tokens, finish): every copy a mixture may hold, in virtual time.

    Sources are compared without case and surrounding blanks. Documents of a null or unlisted
    source, or without tokens, are in no mixture; of a repeated doc_id the row
    of the greatest source, then size, counts. A source listed twice counts once, with its greatest share; shares that are
    null or not above zero, and repeats below one, leave a source out. A source's first
    copies all come before its second ones, each round in its own shuffled order.
    """
    listed = targets.select(normal_source(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce("max_repeats", F.lit(1)).cast("int").alias("most"))
    listed = listed.where("source is not null and share > 0 and most >= 1").groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most"))
    shares = listed.withColumn("share", F.col("share") / F.sum("share").over(Window.partitionBy(F.lit(1))))  # one row for each source
    texts = documents.where("doc_id is not null").select("doc_id", normal_source(F.col("source")).alias("source"), "text").join(F.broadcast(shares.select("source")), "source", "left_semi")
    # repeats go once the texts are numbers, so no text is shuffled for them
    counted = encode(texts, params, count_only=True, keep=("source",)).where("n_tokens > 0")
    sizes = cut(counted.groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens")).alias("row")).select("doc_id", "row.*"))
    copies = sizes.join(shares, "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("most"))))
    turn = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.lit(1 << 40))
    many = max(1, -(-sizes.count() // bucket_rows))
    shuffled = copies.withColumn("turn", turn)
    bucket = F.col("copy") * many + F.floor(F.col("turn") * many / F.lit(1 << 40))
    summed = running_sum(shuffled, "n_tokens", ["source"], [F.col("turn"), F.col("doc_id")], bucket, "source_tokens")
    return summed.withColumn("finish", F.col("source_tokens") / F.col("share")).select("doc_id", "source", "copy", "n_tokens", "source_tokens", "share", "finish")


def mixture(documents: DataFrame, targets: DataFrame, budget: int | None = None, params: TokenParams = TokenParams(), seed: int = 17, bucket_rows: int = 20_000) -> DataFrame:
    """(doc_id, source, copy, n_tokens, finish): what comes first in virtual time, up to ``budget`` tokens in total.

    Without a budget it is the largest for which every source can still give its share. With a
    larger one sources that are used up end, the others go on, and the shares reached show it.
    Copies with equal times are ordered by doc_id and copy.
    """
    timed = cut(virtual_times(documents, targets, params, seed))
    ends = timed.groupBy("source").agg(F.max("finish").alias("end")).agg(F.min("end").alias("first"), F.max("end").alias("last")).first()
    if ends is None or ends["last"] is None:
        return timed.select("doc_id", "source", "copy", "n_tokens", "finish")
    limit = float(ends["first"] if budget is None else budget)
    # equal steps of virtual time: sources advance evenly in it, so a step holds about bucket_rows copies
    buckets = max(1, -(-timed.count() // bucket_rows))
    step = F.least(F.floor(F.col("finish") * buckets / limit), F.lit(1 << 40)).cast("long")
    summed = running_sum(timed.withColumn("all", F.lit(0)), "n_tokens", ["all"], [F.col("finish"), F.col("doc_id"), F.col("copy")], step, "total")
    return summed.where(F.col("total") <= limit).select("doc_id", "source", "copy", "n_tokens", "finish")


def reached_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, n_docs, n_copies, most_copies, n_tokens, actual_share) of a mixture; a source without rows has zeros."""
    total = Window.partitionBy(F.lit(1))  # one row for each source
    per = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("copies"), F.sum("n_tokens").alias("t"))
    got = per.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies"), F.sum("t").alias("n_tokens"))
    wanted = targets.where("source is not null").groupBy(normal_source(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_docs", "n_copies", "most_copies", "n_tokens")}
    return wanted.join(got, "source", "left").withColumns(zero).withColumn("actual_share", F.coalesce(F.col("n_tokens") / F.nullif(F.sum("n_tokens").over(total), F.lit(0)), F.lit(0.0)))
