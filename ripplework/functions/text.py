"""String, regex, JSON and hash expressions for corpora and model answers. All are Column -> Column, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it.
UNI_SPACE = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def fingerprint(c: Column) -> Column:
    """SHA-1 of the lower-cased text with white space collapsed."""
    return F.sha1(strip(F.regexp_replace(F.lower(c), UNI_SPACE, " ")))


def stable_id(*parts: Column) -> Column:
    """16 hex digits of SHA-1 over the parts joined by `::`; null prints None."""
    return F.substring(F.sha1(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])), 1, 16)


def example_id(*parts: Column) -> Column:
    """20 hex digits of SHA-256 over the parts joined by U+001F."""
    return F.substring(F.sha2(F.concat_ws("\u001f", *[p.cast("string") for p in parts]), 256), 1, 20)


def stable_int(c: Column) -> Column:
    """The first 8 hex digits of SHA-1 as a number."""
    return F.conv(F.substring(F.sha1(c), 1, 8), 16, 10).cast("bigint")


def stream_digest(pos: Column, key: Column, value: Column) -> Column:
    """Aggregate: SHA-256 over `key NUL value LF` in order of pos (C05). For groups that fit a task."""
    rows = F.array_sort(F.collect_list(F.struct(pos.alias("p"), key.cast("string").alias("k"), value.alias("v"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r["k"], F.lit("\0"), r["v"], F.lit("\n"))), ""), 256)


def clean_lines(c: Column) -> Column:
    """CR to LF, lines stripped, empty lines dropped."""
    lines = F.transform(F.split(F.replace(c, F.lit("\r"), F.lit("\n")), "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def first_text(*cols: Column) -> Column:
    """The first column that is not blank, else empty."""
    return F.coalesce(*[F.nullif(strip(c), F.lit("")) for c in cols], F.lit(""))


def assemble(title: Column, body: Column) -> Column:
    """Title and body by a blank line, or what there is of them."""
    return F.concat_ws("\n\n", F.nullif(strip(title), F.lit("")), F.nullif(strip(body), F.lit("")))


def last_choice(c: Column) -> Column:
    """The last choice letter: after `####` if that occurs, else standing alone."""
    marked = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?i)####\s*([ABCD])\b"), F.lit(1)), F.lit(-1))
    alone = F.try_element_at(F.regexp_extract_all(c, F.lit(r"(?i)\b([ABCD])\b"), F.lit(1)), F.lit(-1))
    return F.upper(F.coalesce(marked, alone, F.lit("")))


# How answers are written, and the names of the forms.
LETTER_ONLY = r"(?i)^[\s\[\(]*([ABCD])[\s\]\)\.,:;!?]*$"
LABELLED_LETTER = r"(?i)\b(?:final\s+answer|answer|result|option|choice)\s*(?:is\s*)?[:\-]?\s*[\[\(]?\s*([ABCD])\b"
VERBAL_LETTER = r"(?i)\b(?:the\s+)?(?:correct\s+)?answer\s+is\s+([ABCD])\b"
STANDALONE_LETTER = r"(?i)\b([ABCD])\b"
RESULT_LABEL = r"(?i)^\s*result\s*[:\-]"
ANSWER_LABEL = r"(?i)^\s*(?:final\s+answer|answer)\s*(?:is\s*)?[:\-]"


def first_choice(c: Column) -> Column:
    """The first choice letter: whole answer, labelled or spoken within 160 characters, or alone within 80."""
    t = strip(c)
    got = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    near = F.substring(t, 1, 160)
    return F.upper(F.coalesce(got(t, LETTER_ONLY), got(near, LABELLED_LETTER), got(near, VERBAL_LETTER), got(F.substring(t, 1, 80), STANDALONE_LETTER), F.lit("")))


def answer_format(c: Column) -> Column:
    """The form of an answer, by the first rule that fits; null is empty (C11)."""
    t = strip(F.coalesce(c, F.lit("")))
    rules = ((t == "", "empty"), (t.contains("###"), "gsm8k_hash"), (t.rlike(RESULT_LABEL), "result_label"), (t.rlike(ANSWER_LABEL), "answer_label"), (t.rlike(LETTER_ONLY), "letter_only"), (F.substring(t, 1, 160).rlike(VERBAL_LETTER), "verbal_answer"))
    out = None
    for fits, name in rules:
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out.otherwise("other")


#: End-of-sequence markers of common chat templates.
EOS = (r"<\|endoftext\|>", r"<\|im_end\|>", r"<\|eot_id\|>", r"</s>")


def strip_eos(c: Column) -> Column:
    """Trailing end-of-sequence markers and the white space around them removed, as often as they occur."""
    return strip(F.regexp_replace(c, rf"(?:\s*(?:{'|'.join(EOS)}))+\s*$", ""))


NUMBER = r"-?[0-9][0-9,]*(?:\.[0-9]+)?"


def gold_number(c: Column) -> Column:
    """The last number after the last `####` (else of the whole text); without one, that text."""
    tail = F.substring_index(c, "####", -1)
    return F.coalesce(F.try_element_at(F.regexp_extract_all(tail, F.lit(f"({NUMBER})"), F.lit(1)), F.lit(-1)), strip(tail))


def numeric_answer(c: Column, strict: bool) -> Column:
    """The last number, behind `####` only if strict, in canonical form (C14)."""
    p = rf"####\s*({NUMBER})" if strict else f"({NUMBER})"
    return canonical_number(F.try_element_at(F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.lit(-1)))


def solution(c: Column) -> Column:
    """The number behind the first `#### `, commas removed, else N/A."""
    return F.coalesce(F.nullif(F.replace(F.regexp_extract(c, r"#### (\-?[0-9\.,]+)", 1), F.lit(","), F.lit("")), F.lit("")), F.lit("N/A"))


def number_value(c: Column) -> Column:
    """Decimal value after taking off commas, $, % and final dots; null if it is none."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"[,$%]", ""), r"\.+$", "").try_cast("decimal(38,10)")


def same_answer(a: Column, b: Column) -> Column:
    """Equal as numbers (a/b read as fractions, compared crosswise), else as lower-cased text."""

    def parts(c):
        top, bottom = F.substring_index(c, "/", 1), F.when(c.contains("/"), F.substring_index(c, "/", -1)).otherwise(F.lit("1"))
        return number_value(top).cast("double"), number_value(bottom).cast("double")

    (p, q), (r, s) = parts(a), parts(b)
    return F.coalesce(F.when((q != 0) & (s != 0), p * s == r * q), F.lower(strip(a)) == F.lower(strip(b)), F.lit(False))


def canonical_number(c: Column) -> Column:
    """No commas, no trailing zeros, no -0; empty if it is no number (C17)."""
    v = F.replace(c, F.lit(","), F.lit("")).try_cast("decimal(38,10)").cast("string")
    out = F.when(v.contains("."), F.regexp_replace(v, r"\.?0+$", "")).otherwise(v)
    return F.coalesce(F.when(out.isin("-0", "0E-10"), F.lit("0")).otherwise(out), F.lit(""))


def numbers(c: Column) -> Column:
    """All numbers of a text, canonical."""
    return F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})"), F.lit(1)), canonical_number)


def json_object(c: Column, schema: str) -> Column:
    """The outermost JSON object in free text, fences or not; null if it does not parse (C20)."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)


def choice_prompt(question: Column, choices: list[Column]) -> Column:
    """Question, lettered choices, cue."""
    return F.concat_ws("\n", question, *[F.concat(F.lit(f"{x}. "), c) for x, c in zip("ABCDEFGH", choices, strict=False)], F.lit("Answer:"))


def choice_letter(c: Column) -> Column:
    """A letter from an index (0 is A) or a letter."""
    i = c.try_cast("int")
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, "ABCD")), i + 1), F.upper(strip(c)))


def slug(c: Column) -> Column:
    """A name for files and metrics; unknown if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, r"[^0-9A-Za-z_.-]+", "_"), r"^_+|_+$", ""), F.lit("")), F.lit("unknown"))


def token_count(c: Column) -> Column:
    """10K, 5M, 1B or a plain number as a bigint."""
    unit = F.upper(F.regexp_extract(strip(c), r"([KkMmBb])$", 1))
    value = F.regexp_extract(strip(c), r"^([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.floor(value * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)).cast("bigint")


def name_value(c: Column) -> Column:
    """name=value at the first `=` as a struct; null unless both are there."""
    at = F.split(c, "=", 2)
    return F.when((F.size(at) == 2) & (F.get(at, F.lit(0)) != "") & (F.get(at, F.lit(1)) != ""), F.struct(F.get(at, F.lit(0)).alias("name"), F.get(at, F.lit(1)).alias("value")))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def split_supervision(c: Column, least: int = 1, keep: int = 16) -> Column:
    """(prompt, target): the first third of the words, at least one and leaving `keep`, and the rest."""
    w = F.filter(F.split(strip(c), UNI_SPACE), lambda x: x != "")
    k = F.greatest(F.lit(least), F.least(F.floor(F.size(w) / 3).cast("int"), F.size(w) - keep))
    return F.struct(F.array_join(F.slice(w, 1, k), " ").alias("prompt"), F.array_join(F.slice(w, k + 1, F.greatest(F.size(w) - k, F.lit(0))), " ").alias("target"))


def subarray_end(a: Column, p: Column) -> Column:
    """The place after the first occurrence of array p in array a, -1 if none."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(a) - F.size(p), F.lit(0)))
    hit = F.try_element_at(F.filter(starts, lambda i: F.slice(a, i + 1, F.size(p)) == p), F.lit(1))
    return F.coalesce(hit + F.size(p), F.lit(-1))


def parse_layers(spec: str, n: int) -> list[int]:
    """`all`, `last`, negative numbers and comma lists as sorted layer numbers; out of bounds raises."""
    if spec == "all":
        return list(range(n))
    out = {n - 1 if x == "last" else int(x) for x in (y.strip() for y in spec.split(",")) if x}
    out = {x + n if x < 0 else x for x in out}
    if not out or min(out) < 0 or max(out) >= n:
        raise ValueError(f"layers out of bounds: {spec}")
    return sorted(out)


def parse_channels(spec: str) -> list[str]:
    """rh, gh or both, in that order."""
    want = {"rh", "gh"} if spec == "both" else {x.strip() for x in spec.split(",") if x.strip()}
    if not want or want - {"rh", "gh"}:
        raise ValueError(f"unknown channel: {spec}")
    return [x for x in ("rh", "gh") if x in want]


PLACEHOLDER = r"\[\[KEEP_[0-9]{4,}\]\]"


def mask_spans(c: Column, patterns: list[str]) -> Column:
    """(masked, kept): what the patterns protect, replaced by [[KEEP_0000]] and so on.

    One pass of all patterns: the leftmost match counts, of those at one place that of the first pattern; matches that
    touch are one span. A placeholder that the text holds already is protected like any other span. Null stays null.
    """
    every = "(?:" + "|".join([PLACEHOLDER, *(f"(?:{p})" for p in patterns)]) + ")+"
    kept, gaps = F.regexp_extract_all(c, F.lit(every), F.lit(0)), F.split(c, every, -1)
    name = lambda i: F.concat(F.lit("[[KEEP_"), F.when(i < 10_000, F.lpad(i.cast("string"), 4, "0")).otherwise(i.cast("string")), F.lit("]]"))
    masked = F.array_join(F.transform(gaps, lambda g, i: F.when(i < F.size(kept), F.concat(g, name(i))).otherwise(g)), "")
    return F.struct(masked.alias("masked"), kept.alias("kept"))


def unmask_spans(masked: Column, kept: Column) -> Column:
    """The inverse of mask_spans, wherever the placeholders now stand; one without a span stays."""
    marks, gaps = F.regexp_extract_all(masked, F.lit(PLACEHOLDER), F.lit(0)), F.split(masked, PLACEHOLDER, -1)
    number = lambda m: F.regexp_extract(m, "([0-9]+)", 1).try_cast("int")
    back = lambda i: F.coalesce(F.try_element_at(kept, number(F.get(marks, i)) + 1), F.get(marks, i))
    return F.array_join(F.transform(gaps, lambda g, i: F.when(i < F.size(marks), F.concat(g, back(i))).otherwise(g)), "")
