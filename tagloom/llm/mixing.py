"""Temperature mixing of sources to target weights, realised as budgeted block permutations. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.llm.common import cut, hot_join


#: Sources that are weighed in one row; more are refused.
MAX_SOURCES = 1_000_000


def _key(seed: int, *cols) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def source_weights(tokens: DataFrame, budget_ratio: float, entropy_share: float, max_repeats: float, steps: int = 40) -> DataFrame:
    """(source, tokens, weight, alpha, target): weight is proportional to tokens ** alpha.

    alpha is bisected in [0, 1]: the largest for which the entropy is at least entropy_share times ln(sources), then
    raised as far as needed so that no source is repeated more than max_repeats times (alpha 1 repeats all alike).
    tokens has one row (source, tokens) per source; that these rows, MAX_SOURCES at most, fit one task is the operator's
    premise. A limit that no weights can meet, as a budget of more than max_repeats times the tokens, is refused.
    """
    if budget_ratio > max_repeats:
        raise ValueError(f"a budget of {budget_ratio} times the tokens repeats some source more than {max_repeats} times")
    table = tokens.where("tokens > 0").agg(F.sort_array(F.collect_list(F.struct("source", "tokens"))).alias("s"))
    table = table.withColumn("t", F.transform("s", lambda x: x["tokens"].cast("double")))
    table = table.withColumn("all", _total(F.col("t"))).withColumn("share", F.transform("t", lambda x: x / F.col("all")))

    def powers(alpha: Column) -> Column:
        return F.transform("share", lambda x: F.pow(x, alpha))

    def entropy(alpha: Column) -> Column:
        p = powers(alpha)
        z = _total(p)
        return F.log(z) - _total(F.transform(p, lambda x: x * F.log(x))) / z

    def repeats(alpha: Column) -> Column:
        p = powers(alpha)
        return F.array_max(F.transform(F.arrays_zip(p.alias("p"), F.col("share").alias("q")), lambda x: x["p"] / x["q"])) / _total(p) * budget_ratio

    def bisect(left_holds) -> Column:
        """Where left_holds(alpha) turns from True to False, or 1 if it always holds; the last lo of the steps."""
        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))

        def step(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            ok = left_holds(mid)
            return F.struct(F.when(ok, mid).otherwise(acc["lo"]).alias("lo"), F.when(ok, acc["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    least = F.lit(entropy_share) * F.log(F.size("share").cast("double"))
    table = table.withColumn("e", bisect(lambda a: entropy(a) >= least)["lo"])
    table = table.withColumn("r", F.when(repeats(F.lit(0.0)) <= max_repeats, F.lit(0.0)).otherwise(bisect(lambda a: repeats(a) > max_repeats)["hi"]))
    table = table.withColumn("alpha", F.greatest("e", "r")).withColumn("p", powers(F.col("alpha"))).withColumn("z", _total(F.col("p")))
    out = table.select("alpha", "all", "z", F.explode(F.arrays_zip("s", "p")).alias("x"))
    out = out.select(F.col("x.s.source").alias("source"), F.col("x.s.tokens").alias("tokens"), (F.col("x.p") / F.col("z")).alias("weight"), "alpha", "all")
    return out.withColumn("target", F.floor(F.col("weight") * F.col("all") * budget_ratio + 1e-6).cast("bigint"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget_ratio: float = 1.0, entropy_share: float = 0.97, max_repeats: float = 4.0, block_docs: int = 256, seed: int = 7) -> DataFrame:
    """One row (id, source, epoch, block, n_tokens, block_key, doc_key) for each time a document is drawn.

    Tokens are the words between ASCII white space. The budget is budget_ratio times all tokens; source_weights()
    shares it out. Each source is passed through in whole epochs, and its last, partial epoch takes blocks (hash
    groups of about block_docs documents) in an order permuted by epoch while they fit, and of the first block that
    doesn't fit the documents, in permuted order, up to the first that doesn't fit: later ones that would are left
    out, so a source may get less than its share by up to its longest document. Sorting by (block_key, doc_key) gives the training
    order. Running sums go over ranges of block keys per source, blocks per range and documents per block, never over all
    documents or blocks of a source.

    Documents without tokens (null, empty or blank) are never drawn; texts of any length are counted whole. Null sources
    are the source ''. Rows that repeat are drawn each; their order among equals doesn't matter, as they are equal. Null
    ids hash as ''. Other columns are not read. A budget_ratio over max_repeats is refused.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^ \x09-\x0D]+")), F.lit(0)).cast("bigint")
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), words.alias("n_tokens")).where("n_tokens > 0")
    base = cut(base)  # ids and counts only: texts are read and counted once
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    sizes = base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    sizes = cut(sizes)
    if sizes.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    weights = source_weights(sizes.select("source", "tokens"), budget_ratio, entropy_share, max_repeats)
    plan = weights.join(sizes.select(F.col("source"), "docs"), "source").withColumn("blocks", F.ceil(F.col("docs") / block_docs).cast("bigint"))
    plan = cut(plan.select("source", "docs", "blocks", F.expr("target div tokens").alias("whole"), F.expr("target % tokens").alias("rest")))
    slot = F.conv(F.substring(_key(seed, name), 1, 8), 16, 10).cast("bigint")
    placed = hot_join(base, plan, "source", "docs", base.count()).drop("docs").withColumn("block", slot % F.col("blocks"))
    blocks = placed.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    blocks = cut(blocks.withColumn("block_key", _key(seed, "source", "whole", "block")).withColumn("span", F.substring("block_key", 1, 3)))
    spans = blocks.groupBy("source", "span").agg(F.sum("size").alias("all"))  # 4,096 a source at most
    by_span = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.select("source", "span", (F.sum("all").over(by_span) - F.col("all")).alias("start"))
    order = Window.partitionBy("source", "span").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.join(spans, ["source", "span"]).withColumn("upto", F.col("start") + F.sum("size").over(order)).withColumn("before", F.col("upto") - F.col("size"))
    edge = blocks.where("before < rest and upto > rest").select("source", "block", (F.col("rest") - F.col("before")).alias("room"))
    taken = blocks.where("upto <= rest").select("source", "block")
    doc_key = lambda epoch: _key(seed, "source", epoch, name)
    whole = placed.where("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)))
    part = placed.where("rest > 0").withColumn("epoch", F.col("whole"))
    full = part.join(taken, ["source", "block"], "left_semi")
    last = part.join(edge, ["source", "block"]).withColumn("doc_key", doc_key("epoch"))
    within = Window.partitionBy("source", "block").orderBy("doc_key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = last.withColumn("sum", F.sum("n_tokens").over(within)).where("sum <= room")
    cols = ["id", "source", "epoch", "block", "n_tokens"]
    out = whole.select(cols).unionAll(full.select(cols)).unionAll(last.select(cols))
    out = out.withColumn("block_key", _key(seed, "source", "epoch", "block")).withColumn("doc_key", doc_key("epoch"))
    return out.withColumnRenamed("id", id_col)
