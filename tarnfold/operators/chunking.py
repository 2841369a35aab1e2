"""Chunks with quality bounds and a fallback, as columns of the document's row; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnfold.functions import chunking
from tarnfold.functions.markdown import approx_tokens, stripped

# The bounds that a document's chunks must keep.
BOUNDS = {"min_chunk_count": 1, "max_token_ratio_limit": 1.25, "max_duplication_ratio": 0.10, "min_coverage_ratio": 0.80}


def chunked(text: Column, strategy: str, target_tokens: int = 320, max_tokens: int = 400, max_chars: int = 1000) -> Column:
    """The chunks of a strategy; an unknown one is semantic."""
    if strategy == "paragraph":
        return chunking.paragraph_chunks(text, max_chars)
    if strategy == "hierarchical":
        return chunking.hierarchical_chunks(text, max_chars)
    return chunking.semantic_chunks(text, target_tokens, max_tokens)


def quality(chunks: Column, source: Column, max_tokens: int, bounds: dict[str, float] | None = None) -> Column:
    """struct of counts, ratios, violations and passed of a document's chunks against the bounds."""
    once = lambda value, change: F.transform(F.array(value), change)[0]
    sizes = F.transform(chunks, lambda c: F.struct(approx_tokens(c["text"]).alias("tokens"), F.length(c["text"]).alias("chars")))
    counts = F.struct(sizes.alias("sizes"), F.size(F.array_distinct(F.transform(chunks, lambda c: c["text"]))).alias("different"), F.length(stripped(source)).alias("whole"))
    return F.when(chunks.isNotNull(), once(counts, lambda c: once(_totals(c), lambda t: _bounded(t, max_tokens, BOUNDS | (bounds or {})))))


def _totals(c: Column) -> Column:
    """Sums and extremes of the chunks' sizes."""
    total = lambda field: F.aggregate(c["sizes"], F.lit(0), lambda s, x: s + x[field])
    tokens = F.transform(c["sizes"], lambda x: x["tokens"])
    ends = [F.coalesce(f(tokens), F.lit(0)).alias(n) for n, f in (("most", F.array_max), ("least", F.array_min))]
    return F.struct(F.size(c["sizes"]).alias("n"), total("tokens").alias("tokens"), total("chars").alias("chars"), *ends, c["different"], F.greatest(c["whole"], F.lit(1)).alias("whole"))


def _bounded(t: Column, max_tokens: int, b: dict[str, float]) -> Column:
    """What `quality` gives, from totals."""
    n, none = t["n"], t["n"] == 0
    coverage = F.when(none, 0.0).otherwise(t["chars"] / t["whole"])
    ratio = F.when(none, 0.0).otherwise(t["most"] / F.lit(max(max_tokens, 1)))
    duplicated = F.when(none, 0.0).otherwise(1.0 - F.try_divide(t["different"].cast("double"), n))
    wrong = F.array_compact(
        F.array(
            F.when(none, "no_chunks"),
            F.when(~none & (n < int(b["min_chunk_count"])), F.format_string(f"chunk_count=%d < min={int(b['min_chunk_count'])}", n)),
            F.when(~none & (ratio > b["max_token_ratio_limit"]), F.format_string(f"max_token_ratio=%.2f > limit={b['max_token_ratio_limit']:.2f}", ratio)),
            F.when(~none & (duplicated > b["max_duplication_ratio"]), F.format_string(f"duplication_ratio=%.3f > limit={b['max_duplication_ratio']:.3f}", duplicated)),
            F.when(~none & (coverage < b["min_coverage_ratio"]), F.format_string(f"coverage_ratio=%.3f < min={b['min_coverage_ratio']:.3f}", coverage)),
        )
    )
    return F.struct(
        n.alias("chunk_count"), F.coalesce(F.try_divide(t["tokens"].cast("double"), n), F.lit(0.0)).alias("avg_tokens"), t["most"].alias("max_tokens"), t["least"].alias("min_tokens"),
        coverage.alias("coverage_ratio"), ratio.alias("max_token_ratio"), duplicated.alias("duplication_ratio"), (F.size(wrong) == 0).alias("passed"), wrong.alias("violations"),
    )


def with_chunks(docs: DataFrame, strategy: str, text: str = "text", target_tokens: int = 320, max_tokens: int = 400, max_chars: int = 1000, bounds: dict[str, float] | None = None) -> DataFrame:
    """docs with `chunks`, `strategy` (the one used) and `qa`. A document whose chunks break the bounds is chunked by paragraphs; others give that step a null, which costs nothing."""
    asked = strategy if strategy in ("paragraph", "hierarchical") else "semantic"
    size = lambda s: max_chars // 4 if s == "paragraph" else max_tokens
    out = docs.withColumn("chunks", chunked(F.col(text), asked, target_tokens, max_tokens, max_chars))
    out = out.withColumn("qa", quality(F.col("chunks"), F.col(text), size(asked), bounds))
    if asked == "paragraph":
        return out.withColumn("strategy", F.lit(asked))
    out = out.withColumn("_plain", chunking.paragraph_chunks(F.when(~F.col("qa.passed"), F.col(text)), max_chars))
    again = quality(F.col("_plain"), F.col(text), size("paragraph"), bounds)
    out = out.withColumn("_qa", F.when(F.col("_plain").isNotNull(), again))
    return out.withColumns({"strategy": F.when(F.col("_plain").isNull(), asked).otherwise("paragraph"), "chunks": F.coalesce("_plain", "chunks"), "qa": F.coalesce("_qa", "qa")}).drop("_plain", "_qa")


def chunk_rows(docs: DataFrame, *keep: str) -> DataFrame:
    """A row a chunk of docs with `chunks`. An outer explode and a filter after it: a plain one makes Spark ask for the chunks' number below, and so chunk twice."""
    return docs.select(*keep, F.explode_outer("chunks").alias("c")).filter("c IS NOT NULL").select(*keep, "c.*")
