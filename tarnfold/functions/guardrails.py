"""Checks and parsers of model output as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnfold.functions.markdown import BLANKS, bound, count_headings, stripped

# How models open, close and comment on their output.
OPENERS = (
    r"(?i)^(?:here\s+is|below\s+is|sure[,!]?\s|certainly[,!]?\s|of\s+course[,!]?\s|i(?:'ve|’ve| have)\s+(?:made|improved|refined|cleaned|corrected|fixed|updated)"
    r"|the\s+(?:improved|refined|corrected|updated|cleaned)\s+(?:document|markdown|text|version)|i\s+(?:noticed|found|see|observe|detected)|as\s+(?:an?\s+ai|requested|instructed))"
)
CLOSERS = (
    r"(?i)^(?:let\s+me\s+know|i\s+hope\s+this|feel\s+free|if\s+you\s+(?:need|want|have)|please\s+(?:let|don't\s+hesitate)|don't\s+hesitate|is\s+there\s+anything\s+else"
    r"|note:\s+i(?:'ve|’ve| have)\s+(?:made|kept|preserved)|i\s+(?:made|kept|preserved)\s+(?:the\s+following|all|every)|summary\s+of\s+(?:changes|improvements|modifications))"
)
META = r"(?i)^#{1,3}\s+(?:summary\s+of\s+changes|improvements?\s+made|changes?\s+(?:log|list|summary)|notes?\s+on\s+(?:changes|improvements)|what\s+(?:was|i)\s+(?:changed|improved|fixed))\s*$"
WRAPPER = r"(?s)\A```(?:markdown|md|text)?\s*\n(.*?)\n```\s*\z"
SCANNED, VALVE_CHARS, VALVE_SHARE = 5, 200, 0.5
WORD = r"[\p{L}\p{N}_]"
THOUSANDS = rf"(?<=[0-9])[,\x{{a0}}\x{{202f}} ](?=[0-9]{{3}}(?!{WORD}))"
DIGIT = r"\p{Nd}"
DIMENSIONS = ("faithfulness", "formatting", "cohesion", "hallucination_risk")


def strip_reasoning(text: Column, tag: str = "think", blanks: str | Column = BLANKS) -> Column:
    """Without closed blocks of the tag, and without what follows one that is left open."""
    return F.btrim(F.regexp_replace(F.regexp_replace(text, f"(?s)<{tag}>.*?</{tag}>", ""), f"(?s)<{tag}>(?:(?!</{tag}>).)*$", ""), F.lit(blanks))


def _leading(lines: Column, pattern: str, scanned: int | Column, blanks: str | Column) -> Column:
    """How many of the first lines go: up to the last that fits, blanks between allowed, until one that doesn't."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("cut"), F.lit(True).alias("on"))

    def step(s: Column, x: Column) -> Column:
        fits = x.rlike(pattern)
        return F.struct((s["i"] + 1).alias("i"), F.when(s["on"] & fits, s["i"] + 1).otherwise(s["cut"]).alias("cut"), (s["on"] & ((x == "") | fits)).alias("on"))

    return F.aggregate(F.transform(F.slice(lines, 1, scanned), lambda x: F.btrim(x, F.lit(blanks))), start, step, lambda s: s["cut"])


def strip_artifacts(text: Column, head: int | Column = SCANNED, foot: int | Column = SCANNED, blanks: str | Column = BLANKS) -> Column:
    """Model output without its wrapping fence, opening and closing remarks, and sections about the changes.

    Of a text above VALVE_CHARS, of which less than VALVE_SHARE would be left, all is kept.
    A section about changes ends at the next heading; its lines are found by the headings
    alone, which are numbered as they come. Remarks are looked for in the first head and
    the last foot lines; fewer, where it is known which lines are the text's own.
    """
    def without(t: Column) -> Column:
        bare = t["bare"]
        body = F.when(bare.rlike(WRAPPER), F.regexp_replace(bare, WRAPPER, "$1")).otherwise(t["text"])
        lines = bound(F.split(body, "\n", -1), lambda x: F.slice(x, _leading(x, OPENERS, head, blanks) + 1, F.greatest(F.size(x), F.lit(1))))
        lines = bound(lines, lambda x: F.slice(x, 1, F.greatest(F.size(x) - _leading(F.reverse(x), CLOSERS, foot, blanks), F.lit(0))))
        # Cut at headings: a part is a heading's line and what follows.
        parts = F.split(F.array_join(lines, "\n"), r"(?m)^(?=#{1,6}\s)|^(?=[ \t]+#{1,3}\s+(?i:summary|improvement|change|note|what))", -1)
        kept = F.filter(parts, lambda p: ~F.btrim(F.substring_index(p, "\n", 1), F.lit(blanks)).rlike(META))
        valve = lambda done: (F.length(bare) > VALVE_CHARS) & (F.length(done) < F.length(bare) * VALVE_SHARE)
        return F.when(bare == "", t["text"]).otherwise(bound(F.btrim(F.array_join(kept, ""), F.lit(blanks)), lambda done: F.when(valve(done), t["text"]).otherwise(done)))

    return bound(F.struct(text.alias("text")), lambda t: bound(F.struct(t["text"].alias("text"), F.btrim(t["text"], F.lit(blanks)).alias("bare")), without))


def is_fact(token: Column, digit: str = DIGIT) -> Column:
    """At least half of the characters are digits."""
    digits = F.length(F.regexp_replace(token, f"[^{digit}]", ""))
    return (digits > 0) & (digits * 2 >= F.length(token))


def facts(text: Column, separators: str = THOUSANDS, digit: str = DIGIT) -> Column:
    """The distinct digit-heavy words of three characters or more, lower-cased, thousands separators (what the pattern matches) taken out. A word without a digit is passed over as a whole."""
    with_digit = f"(?<!{WORD})[{WORD}&&[^{digit}]]*+[{digit}]{WORD}*+"
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(text, separators, ""), F.lit(with_digit), F.lit(0)))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 3) & is_fact(w, digit)), F.lower))


def dropped_facts(before: Column, after: Column, limit: int = 10, of: Callable[[Column], Column] = facts) -> Column:
    """Facts of before that after lacks, sorted, the first ones."""
    return F.slice(F.array_sort(F.array_except(of(before), of(after))), 1, limit)


def refine_verdict(before: Column, after: Column, least_length: float = 0.85, least_headings: float = 0.8, of: Callable[[Column], Column] = facts) -> Column:
    """Why a refinement is refused: output_too_short, sections_dropped, facts_dropped; null if it may stand."""
    had = count_headings(before)
    return (
        F.when(F.length(stripped(after)) < F.length(stripped(before)) * least_length, "output_too_short")
        .when((had >= 3) & (count_headings(after) < had * least_headings), "sections_dropped")
        .when(F.size(dropped_facts(before, after, of=of)) > 0, "facts_dropped")
    )


def improvements(before: Column, after: Column) -> Column:
    """What a refinement changed, in words."""
    signs = lambda t: F.length(t) - F.length(F.replace(t, F.lit("#"), F.lit("")))
    said = F.array_compact(F.array(F.when(F.length(before) != F.length(after), "Length adjusted"), F.when(signs(before) != signs(after), "Heading structure improved"), F.when(before != after, "Content refined")))
    return F.when(F.size(said) == 0, F.array(F.lit("No changes made"))).otherwise(said)


def first_int(raw: Column) -> Column:
    """The number that a value begins with, whatever emphasis or brackets stand around it."""
    plain = F.regexp_replace(stripped(F.regexp_replace(raw, r"[*_`\[\]()]", "")), r"\.+$", "")
    return F.regexp_extract(plain, r"^([+-]?\d+)(?:\s|$)", 1).try_cast("int")


def judge_scores(response: Column) -> Column:
    """struct of the four dimensions' scores (1 to 5) and the rationale in a judge's response.

    Lines are `KEY: value`, keys also as `SCORE (KEY)`; the last of a dimension counts. A
    `SCORE` line stands for all dimensions if none is named before it; without any number
    all are 3. A dimension that is not named, while others are, is null.
    """
    lines = F.transform(F.split(stripped(strip_reasoning(response)), "\n", -1), lambda x: F.struct(F.upper(stripped(F.substring_index(x, ":", 1))).alias("key"), stripped(F.substr(x, F.length(F.substring_index(x, ":", 1)) + 2)).alias("value"), F.contains(x, F.lit(":")).alias("said")))
    known = F.filter(lines, lambda x: x["said"])
    named = F.transform(known, lambda x: F.struct(F.when(x["key"].rlike(r"^SCORE\s*\((\w[\w\s]*)\)"), stripped(F.regexp_extract(x["key"], r"^SCORE\s*\((\w[\w\s]*)\)", 1))).otherwise(x["key"]).alias("key"), x["value"].alias("value"), first_int(x["value"]).alias("n")))
    clamp = lambda n: F.when(n.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(5), n)))
    numbered = F.filter(named, lambda x: x["n"].isNotNull() & x["key"].isin("SCORE", *[d.upper() for d in DIMENSIONS]))
    first = F.try_element_at(numbered, F.lit(1))
    overall = F.when(first["key"] == "SCORE", clamp(first["n"]))  # a SCORE line counts while no dimension is known
    last = lambda d: clamp(F.try_element_at(F.filter(numbered, lambda x: x["key"] == d.upper()), F.lit(-1))["n"])
    none = F.size(numbered) == 0
    told = F.try_element_at(F.filter(named, lambda x: x["key"] == "RATIONALE"), F.lit(-1))["value"]
    return F.struct(*[F.when(none, 3).otherwise(F.coalesce(last(d), overall)).cast("int").alias(d) for d in DIMENSIONS], F.coalesce(told, F.lit("Unable to parse response")).alias("rationale"))


def composite(scores: Column) -> Column:
    """The mean of the known dimensions, half to even; 3 without any."""
    known = F.array_compact(F.array(*[scores[d] for d in DIMENSIONS]))
    return F.coalesce(F.bround(F.try_divide(F.aggregate(known, F.lit(0), lambda s, x: s + x).cast("double"), F.size(known))).cast("int"), F.lit(3))


# What metadata falls back to.
TAG_SCHEMA = "topic string, keywords variant, density string, concepts variant, complexity_score variant, domain string"
LISTED = "array<string>"


def _listed(v: Column) -> Column:
    """A list from a JSON list, from words between commas, or from a single value."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    words = F.filter(F.transform(F.split(text, ","), stripped), lambda w: w != "")
    return F.when(v.isNull() | F.is_variant_null(v), F.array().cast(LISTED)).when(kind.startswith("ARRAY"), F.try_variant_get(v, "$", LISTED)).when(kind == "STRING", words).otherwise(F.array(text))


def metadata_tags(raw: Column, tier: Column) -> Column:
    """struct(topic, keywords, density, concepts, complexity_score, domain, raw) from a model's JSON.

    What is no JSON object gives the topic `unparsed` and keeps its first 5,000 characters.
    Tier 2 fills concepts, complexity_score and domain too; otherwise they are null unless given.
    """
    v = F.try_parse_json(raw)
    is_map = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    get = lambda name, kind="string": F.try_variant_get(v, f"$.{name}", kind)
    more = lambda value, default: F.coalesce(value, F.when(tier >= 2, default))
    concepts = F.when(get("concepts", "variant").isNotNull() | (tier >= 2), _listed(get("concepts", "variant")))
    good = F.struct(
        F.coalesce(get("topic"), F.lit("unknown")).alias("topic"), _listed(get("keywords", "variant")).alias("keywords"), F.coalesce(get("density"), F.lit("general")).alias("density"), concepts.alias("concepts"),
        more(get("complexity_score", "int"), F.lit(5)).alias("complexity_score"), more(get("domain"), F.lit("general")).alias("domain"), F.lit(None).cast("string").alias("raw"),
    )
    bad = F.struct(
        F.lit("unparsed").alias("topic"), F.array(F.lit("unparsed")).alias("keywords"), F.lit("general").alias("density"), F.when(tier >= 2, F.array().cast(LISTED)).alias("concepts"),
        F.when(tier >= 2, F.lit(5)).alias("complexity_score"), F.when(tier >= 2, "general").alias("domain"), F.left(raw, F.lit(5000)).alias("raw"),
    )
    return F.when(is_map, good).otherwise(bad)


def suggestion_of(response: Column) -> Column:
    """struct(rule_yaml, rationale) of a model's JSON, also inside a fence; null if it is none, for the heuristic to stand in."""
    v = F.try_parse_json(F.regexp_replace(stripped(response), r"(?s)\A```[a-z]*\s*\n(.*?)\n```\s*\z", "$1"))
    return F.when(F.try_variant_get(v, "$.rule_yaml", "string").isNotNull(), F.struct(F.try_variant_get(v, "$.rule_yaml", "string").alias("rule_yaml"), F.coalesce(F.try_variant_get(v, "$.rationale", "string"), F.lit("")).alias("rationale")))
