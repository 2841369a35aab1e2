"""Quality decisions about documents and runs, as column expressions."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfold.functions.guardrails import DIMENSIONS
from tarnfold.functions.markdown import bound, estimated_tokens, stripped


def hitl_priority(judge_score: Column, sensitive: Column) -> Column:
    return (10 - judge_score) * F.when(sensitive, 2.0).otherwise(1.0)


def fidelity_flag(score: Column, retries: Column, most: int) -> Column:
    return F.when(retries >= most, "needs_review").when(score.isNull(), "verified").when(score >= 4, "verified").when(score <= 2, "low_confidence").otherwise("partial")


def metadata_tier(score: Column) -> Column:
    return F.when(score.between(3, 4), 2).otherwise(1)


def fits_in_context(n_in: Column, context: int, overhead: int, ratio: float, most_out: int) -> Column:
    out = (n_in * ratio).cast("int")
    return (n_in + overhead + out <= context) & (out <= most_out)


@dataclass(frozen=True)
class Routing:
    """Thresholds of the routing table. A floor of 0 asks for nothing, and so does a fail_fast of 0."""

    cutoff: int = 4
    fail_fast: int = 0
    clean_again: bool = False
    floors: dict[str, int] = field(default_factory=dict)


# Nodes that have one way on, the scores of ways of extraction, and what a node may lead to.
NEXT = {"refine": "judge", "metadata": "embeddings", "embeddings": "chunking", "chunking": "commit", "commit": "completed", "hitl": "completed"}
CONTENT = ("faithfulness", "cohesion", "hallucination_risk")
EXTRACTION = {"embedded_text": 5, "ocr": 3, "docling_default": 4}
MOVES = {
    "ingest": ["cleanup", "failed"], "cleanup": ["judge", "hitl", "failed"], "judge": ["refine", "cleanup", "metadata", "hitl", "failed"], "refine": ["judge", "hitl", "failed"], "metadata": ["embeddings", "failed"],
    "embeddings": ["chunking", "failed"], "chunking": ["commit", "failed"], "commit": ["completed", "failed"], "hitl": ["judge", "completed"],
}


def _after_judge(r: Routing) -> Column:
    score, retries, most, sub = F.coalesce(F.col("score"), F.lit(3)), F.col("retries"), F.col("max_retries"), F.col("sub_scores")
    left, low = retries < most, score < r.cutoff
    before = F.when((F.size("history") >= 2) & (retries > 0), F.try_element_at(F.col("history"), F.lit(-2)))
    go = lambda target, back=False: F.struct(F.lit(target).alias("target"), F.lit(back).alias("rollback"))
    out = F.when(F.coalesce(F.col("resumed"), F.lit(False)), go("metadata"))
    if r.fail_fast:
        out = out.when(score <= r.fail_fast, go("failed"))
    for dimension, floor in r.floors.items():
        if floor:
            out = out.when(sub.isNotNull() & (F.coalesce(sub[dimension], F.lit(5)) < floor) & left, go("refine"))
    if r.clean_again:
        fine = sub.isNotNull() & (F.col("cleanup_passes") < 1) & (F.coalesce(sub["formatting"], score) < r.cutoff)
        for d in CONTENT:
            fine = fine & (F.coalesce(sub[d], score) >= r.cutoff)
        out = out.when(fine & left, go("cleanup"))
    return (
        out.when(score < before, F.when(before < r.cutoff, go("hitl", True)).otherwise(go("metadata", True)))
        .when((score <= before) & low, go("hitl"))
        .when(low & left, go("refine"))
        .when((F.col("needs_hitl") | ~left) & low, go("hitl"))
        .otherwise(go("metadata"))
    )


def route(r: Routing) -> Column:
    """struct(target, rollback) for a document's state, as one CASE in the table's order.

    Columns: current_node, ocr_confidence, health_score, rule_tags, score, sub_scores,
    retries, max_retries, needs_hitl, history (scores, this one last), cleanup_passes, resumed.
    """
    node = F.col("current_node")
    go = lambda target: F.struct(F.lit(target).alias("target"), F.lit(False).alias("rollback"))
    poor = (F.col("ocr_confidence") < 0.3) | (F.coalesce(F.col("health_score"), F.lit(5)) <= r.fail_fast)
    out = F.when((node == "ingest") & (F.lit(r.fail_fast) != 0) & F.coalesce(poor, F.lit(False)), go("failed")).when(node == "ingest", go("cleanup"))
    tagged = lambda t: (node == "cleanup") & F.coalesce(F.array_contains("rule_tags", t), F.lit(False))
    out = out.when(tagged("hard_failure"), go("failed")).when(tagged("suspicious_content"), go("hitl")).when(node == "cleanup", go("judge")).when(node == "judge", _after_judge(r))
    for at, to in NEXT.items():
        out = out.when(node == at, go(to))
    return out.otherwise(go("failed"))


def may_move(current: Column, target: Column) -> Column:
    """Whether the state machine allows the move."""
    table = F.create_map(*[x for at, to in MOVES.items() for x in (F.lit(at), F.array(*map(F.lit, to)))])
    return F.coalesce(F.array_contains(F.try_element_at(table, current), target), F.lit(False))


def converter_health(method: Column, length: Column, rotated: Column, mixed: Column, shapes: Column) -> Column:
    """struct(score 1 to 5, warnings) of an extraction: the mean of four signals, half to even."""
    known = F.create_map(*[x for k, v in EXTRACTION.items() for x in (F.lit(k), F.lit(v))])
    signals = [
        F.coalesce(F.try_element_at(known, F.coalesce(method, F.lit("unknown"))), F.lit(2)),
        F.when(length == 0, 1).when(length < 50, 2).when(length < 200, 3).when(length < 2000, 4).otherwise(5),
        F.when(mixed, 2).when(rotated, 3).otherwise(5),
        F.when(shapes, 1).otherwise(5),
    ]
    said = F.array_compact(
        F.array(
            F.when(method == "ocr", "OCR extraction may reduce fidelity"), F.when(length == 0, "Empty markdown — no text extracted").when(length < 50, "Very short markdown (<50 chars)"),
            F.when(mixed, "Mixed page rotations detected").when(rotated, "Non-zero page rotation detected"), F.when(shapes, "Text-as-shapes suspected — OCR likely needed"),
        )
    )
    mean = sum(signals[1:], signals[0]).cast("double") / len(signals)
    return F.struct(F.greatest(F.lit(1), F.least(F.lit(5), F.bround(mean).cast("int"))).alias("score"), said.alias("warnings"))


# The deterministic provider's marks and the misread words that it knows.
UNFIXABLE, REFINED = "[UNFIXABLE]", "[REFINED]"
MISREAD = {"Ov3rview": "Overview", "syst3m": "system", "c0nsists": "consists"}


def judged_offline(text: Column) -> Column:
    """The deterministic judge's score of a document."""
    t = stripped(F.coalesce(text, F.lit("")))
    foreign = F.length(F.regexp_replace(t, r"[\x00-\x7f]", ""))
    misread = F.lit(False)
    for word in MISREAD:
        misread = misread | F.contains(t, F.lit(word))
    return F.when((t == "") | F.contains(t, F.lit(UNFIXABLE)), 1).when(F.contains(t, F.lit(REFINED)), 5).when(foreign / F.length(t) > 0.15, 1).when(misread, 3).when(F.contains(t, F.lit("#")) & (F.length(t) >= 80), 5).otherwise(4)


def refined_offline(text: Column) -> Column:
    """The deterministic refiner: misread words set right, a title where there is none; what is marked unfixable stays."""
    fixed = text
    for wrong, right in MISREAD.items():
        fixed = F.replace(fixed, F.lit(wrong), F.lit(right))
    titled = bound(fixed, lambda t: F.when(t.rlike(r"(?U)^\s*#"), t).otherwise(F.concat(F.lit("# Overview\n\n"), t)))
    return F.when(F.contains(text, F.lit(UNFIXABLE)), text).otherwise(F.concat(F.lit(f"{REFINED}\n"), titled))


def metadata_offline(content: Column) -> Column:
    """The deterministic metadata's JSON: tags from the hash of the first 200 characters."""
    h = F.left(F.sha2(F.left(F.coalesce(content, F.lit("")), F.lit(200)), 256), F.lit(8))
    return F.format_string('{"density": "general", "keywords": ["deterministic", "%s"], "topic": "deterministic-%s"}', h, h)


def judge_result(text: Column, cutoff: int, context: int, model: str, prompt_hash: str) -> Column:
    """struct(score, version, needs_refinement): a document too large to be judged gets the cutoff and says so in its version."""
    fits = fits_in_context(estimated_tokens(text), context, 2000, 0.0, 2**31 - 1)
    score = judged_offline(text)
    return F.when(fits, F.struct(score.alias("score"), F.lit(f"{model}:ph-{prompt_hash}").alias("version"), (score < cutoff).alias("needs_refinement"))).otherwise(
        F.struct(F.lit(cutoff).alias("score"), F.lit(f"skipped-oversize:{model}").alias("version"), F.lit(False).alias("needs_refinement"))
    )


def prompt_hash(*parts: str) -> str:
    """Twelve hexadecimal digits that differ with any of the prompt's parts."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()[:12]


def refine_mode(text: Column, context: int, most_out: int, ratio: float = 1.15, overhead: int = 500) -> Column:
    """holistic where a document and its rewriting fit the model, else sectional."""
    return F.when(fits_in_context(estimated_tokens(text), context, overhead, ratio, most_out), "holistic").otherwise("sectional")


def refine_prompt(text: Column, score: Column, retries: Column, most: int, sub_scores: Column, rationale: Column) -> Column:
    """The request to refine: which attempt it is, the judge's scores with those below 4 marked, and the document."""
    last = retries + 1 >= most
    label = {d: d.replace("_", " ").title() for d in DIMENSIONS}
    lines = [F.when(sub_scores[d].isNotNull(), F.concat(F.lit(f"  {label[d]}: "), sub_scores[d].cast("string"), F.lit("/5"), F.when(sub_scores[d] < 4, " ← focus here").otherwise(""))) for d in DIMENSIONS]
    weak = F.array_compact(F.array(*[F.when(sub_scores[d] < 4, F.lit(label[d])) for d in DIMENSIONS]))
    return F.array_join(
        F.array_compact(
            F.array(
                F.concat(F.lit("Attempt "), (retries + 1).cast("string"), F.lit(f" of {most} ("), F.when(last, "final attempt — be thorough").otherwise("earlier attempt — focus on biggest issues"), F.lit(")")),
                F.concat(F.lit("\nJUDGE FEEDBACK (composite "), score.cast("string"), F.lit("/5):")), *[F.when(sub_scores.isNotNull(), x) for x in lines],
                F.when(sub_scores.isNull(), F.concat(F.lit("  Overall: "), score.cast("string"), F.lit("/5"))), F.when(F.size(weak) > 0, F.concat(F.lit("Priority areas: "), F.array_join(weak, ", "))),
                F.when(F.coalesce(rationale, F.lit("")) != "", F.concat(F.lit("Rationale: "), rationale)), F.concat(F.lit("\nDocument to improve:\n"), text), F.lit("\nImproved Document:"),
            )
        ),
        "\n",
    )


def judge_prompt(text: Column, examples: list[tuple[str, str]], reference: Column | None = None) -> Column:
    """The request to judge: examples, the text before refinement if there is one, and the document."""
    shown = "\n\n".join(f"Example {i}:\nInput: {a}\nOutput: {b}" for i, (a, b) in enumerate(examples, 1))
    before = F.lit("") if reference is None else F.coalesce(F.concat(F.lit("\nReference (the text before refinement; its own slips are no infidelity):\n\n"), reference, F.lit("\n")), F.lit(""))
    return F.concat(F.lit(shown + "\n"), before, F.lit("\nNow grade this document:\n\n"), text, F.lit("\n\nYour response:"))


def text_quality(text: Column) -> Column:
    """struct(chars, words, alpha_ratio, garbled_ratio) of an extracted text."""
    t = stripped(F.coalesce(text, F.lit("")))
    n = F.length(t)
    solid = F.length(F.regexp_replace(t, r"(?U)\s", ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    garbled = n - F.length(F.regexp_replace(t, r"[\x{fffd}\x00-\x08\x0b\x0c\x0e-\x1f]", ""))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return F.struct(n.alias("chars"), F.regexp_count(t, F.lit(r"(?U)\b\w+\b")).alias("words"), ratio(letters, solid).alias("alpha_ratio"), ratio(garbled, n).alias("garbled_ratio"))


def passes_gate(quality: Column, alpha: float = 0.20, garbled: float = 0.02, chars: int = 0, words: int = 0) -> Column:
    """Whether an extracted text is good enough; the share of letters counts from 100 characters on."""
    poor = (quality["garbled_ratio"] > garbled) | ((quality["chars"] >= 100) & (quality["alpha_ratio"] < alpha)) | (quality["chars"] < chars) | (quality["words"] < words)
    return ~poor


def suggested_steps(text: Column, issues: Column) -> Column:
    """The clean-up steps that a sample and what is said about it call for, in order."""
    lines = F.split(text, "\n", -1)
    full = F.filter(lines, lambda x: stripped(x) != "")
    mean = F.try_divide(F.aggregate(F.transform(full, F.length), F.lit(0), lambda s, x: s + x).cast("double"), F.size(full))
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?m)^\s*([*+-]) "), 1))
    said = F.lower(F.concat(text, F.lit(" "), issues))
    under = F.exists(F.sequence(F.lit(2), F.greatest(F.size(lines), F.lit(2))), lambda i: (stripped(F.coalesce(F.try_element_at(lines, i - 1), F.lit(""))) != "") & stripped(F.coalesce(F.try_element_at(lines, i), F.lit(""))).rlike("^(===|---)"))
    return F.array_compact(
        F.array(
            F.when((mean < 80) & (F.size(full) > 5), "merge_hardwrapped_paragraphs"), F.when(F.size(marks) > 1, "fix_bullets"), F.when(under, "normalize_headings"),
            F.when(said.rlike("header|footer|page number|watermark"), "strip_headers_footers"), F.when(said.rlike("ocr|garbled|noise|artifact"), "strip_lines_matching"),
        )
    )


def chunk_id(parts: list[Column]) -> Column:
    """A stable UUID (version and variant bits of 5) from the first 16 bytes of the sha256 of the colon-joined parts."""
    h = F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def vision_messages(image_uri: Column, markdown: Column, system: str, ask: str) -> Column:
    """The messages of a model that sees a page: what it shall do, the page's image in full detail, and what is asked of the markdown, fenced, that was read from it. JSON, as a model's interface takes it."""
    image = F.struct(F.lit("image_url").alias("type"), F.struct(image_uri.alias("url"), F.lit("high").alias("detail")).alias("image_url"))
    text = F.struct(F.lit("text").alias("type"), F.concat(F.lit(f"{ask}\n\n```markdown\n"), F.coalesce(markdown, F.lit("")), F.lit("\n```")).alias("text"))
    user = F.concat(F.lit('{"role":"user","content":['), F.to_json(image), F.lit(","), F.to_json(text), F.lit("]}"))
    return F.concat(F.lit("["), F.to_json(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), F.lit(","), user, F.lit("]"))


def data_uri(content: Column, mime: str = "image/png") -> Column:
    """Bytes as a URI that holds them."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(content))
