"""Text expressions, Column to Column, all of them JVM-side.

White space is Unicode's unless a name says otherwise, words are runs of letters, digits and underscores, and a null text
is an empty one. SQL twins of the simple ones are in curata.plans.catalog, where DuckDB checks them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str.split() has it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
WORD = r"[\p{L}\p{N}_]+"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def clean_text(x: Column) -> Column:
    """Null becomes empty; white space runs become one space; no white space at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), SPACE, " "))


def clean_number(x: Column) -> Column:
    """clean_text of a value that isn't text: zero, false and null are empty."""
    s = x.cast("string")
    return F.when(s.isNull() | s.isin("0", "0.0", "false"), "").otherwise(s)


def strip(x: Column, chars: str) -> Column:
    """x without any of chars at its ends."""
    return F.btrim(x, F.lit(chars))


def phrases(x: Column) -> Column:
    """The clean, non-empty parts between commas and semicolons, without dots and spaces at their ends."""
    parts = F.transform(F.split(clean_text(x), r"[,;]\s*"), lambda p: strip(clean_text(p), " ."))
    return F.filter(parts, lambda p: p != "")


def distinct_ignoring_case(items: Column) -> Column:
    """The first of each set of items that differ by case alone, in order: n log n, by sorting places by their text."""
    placed = F.array_sort(F.transform(items, lambda p, i: F.struct(F.lower(p).alias("low"), i.alias("i"))))
    first = let(placed, lambda a: F.filter(a, lambda x, j: (j == 0) | (F.get(a, j - 1)["low"] != x["low"])))
    return let(items, lambda own: F.transform(F.array_sort(F.transform(first, lambda x: x["i"])), lambda i: F.get(own, i)))


def dedupe_comma_phrases(x: Column, most: int = 32) -> Column:
    return F.array_join(F.slice(let(phrases(x), distinct_ignoring_case), 1, most), ", ")


def has_repeated_comma_phrases(x: Column) -> Column:
    """Four phrases or more, some of them equal but for case."""
    return let(F.transform(phrases(x), F.lower), lambda a: (F.size(a) >= 4) & (F.size(F.array_distinct(a)) < F.size(a)))


def tokens(x: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(F.lower(clean_text(x)), F.lit(pattern), F.lit(0))


def most_repeats(words: Column, window: int = 3) -> Column:
    """How often the commonest n-gram of an array of words stands in it. Sorts 64-bit hashes of the n-grams and takes the
    longest run of equal ones: n log n, within one row."""
    hashes = lambda w: F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(window))))).otherwise(F.array().cast("array<bigint>"))

    def longest(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i - 1) != F.get(s, i)))
        runs = let(starts, lambda b: F.transform(b, lambda x, j: F.coalesce(F.get(b, j + 1), F.size(s)) - x))
        return F.when(F.size(s) == 0, 0).otherwise(F.array_max(runs))

    return let(F.array_sort(let(words, hashes)), longest)


def has_token_repetition(x: Column, window: int = 3, most: int = 3) -> Column:
    """A run of `window` ASCII tokens that stands `most` times or more."""
    w = tokens(x, "[a-zA-Z][a-zA-Z0-9_-]*")
    return let(w, lambda a: (F.size(a) >= window * most) & (most_repeats(a, window) >= most))


def has_char_run(x: Column, most: int = 12) -> Column:
    """A character more than `most` times in a row."""
    return clean_text(x).rlike(rf"(.)\1{{{most},}}")


def has_word_run(x: Column, least: int = 4, pattern: str = WORD) -> Column:
    """A word `least` times or more in a row."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(acc: Column, w: Column) -> Column:
        run = F.when(acc["last"] == w, acc["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), F.greatest(acc["top"], run).alias("top"))

    return F.aggregate(tokens(x, pattern), start, step, lambda acc: acc["top"]) >= least


def has_bad_repetition(x: Column) -> Column:
    """A character run, a word run, or a word trigram three times or more among nine words or more."""
    grams = let(tokens(x), lambda a: (F.size(a) >= 9) & (most_repeats(a) >= 3))
    return has_char_run(x) | has_word_run(x) | grams


def trim_words(x: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(clean_text(x), " "), 1, n), " ")


def sanitize_title(x: Column) -> Column:
    """No quotes, brackets or bars; no punctuation at the ends."""
    s = F.translate(clean_text(x), "{}[]|\"'", "     ")
    return strip(F.trim(F.regexp_replace(s, r"\s+", " ")), " ,.;:")


#: The fallback prompt's title and tail.
FALLBACK_TITLE = "news event"
FALLBACK_TAIL = (
    ". non-photorealistic editorial illustration, news thumbnail, flat vector cut-paper style, symbolic visual metaphor, "
    "clear central subject, simple background, balanced composition, muted contrast, no readable text, no exact logos, no watermark"
)


def fallback_prompt(title: Column, most: int = 18) -> Column:
    safe = trim_words(sanitize_title(title), most)
    return strip(F.concat(F.when(safe == "", FALLBACK_TITLE).otherwise(safe), F.lit(FALLBACK_TAIL)), " ,.;:")


def for_similarity(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(clean_text(x)), "[_-]+", " "), r"\s+", " "))


def canonical_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def canonical_label(x: Column) -> Column:
    return F.translate(F.lower(F.trim(x)), "- ", "__")


def slugify(x: Column, most: int = 120) -> Column:
    """Letters, digits, hyphens and single underscores, at most `most` of them; "item" if nothing is left."""
    s = F.regexp_replace(clean_text(x), r"[^\p{L}\p{N}_-]", "_")
    s = F.left(strip(F.regexp_replace(s, "_{2,}", "_"), "_"), F.lit(most))
    return F.when(s == "", "item").otherwise(s)


def stable_seed(*parts: Column) -> Column:
    """A 32-bit seed: the first eight hex digits of the SHA-256 of the parts, joined by two bars."""
    joined = F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.sha2(joined, 256), 1, 8), 16, 10).cast("bigint")


#: The style phrases that may go before or after a prompt.
STYLES = {
    "none": "",
    "editorial": "clean text-free editorial illustration, non-photorealistic news image, complete simplified people only, no realistic faces, no portraits, no close-up faces, no readable letters, no logos",
    "symbolic": "symbolic text-free editorial illustration, non-photorealistic news graphic, complete simplified people only, no realistic faces, no portraits, no close-up faces, no readable letters, no logos",
    "flat_vector": "flat vector text-free editorial illustration, clean news graphic, complete simplified people only, no realistic faces, no portraits, no close-up faces, no readable letters, no logos",
    "silhouette": "faceless silhouette text-free editorial illustration, simplified figures, complete simplified people only, no realistic faces, no portraits, no close-up faces, no readable letters, no logos",
}


def styled_prompt(prompt: Column, profile: str, position: str = "prefix") -> Column:
    """The prompt with its profile's phrase, unless it has it already."""
    p, style = clean_text(prompt), STYLES.get(profile, "")
    if not style:
        return p
    joined = F.concat(p, F.lit(", " + style)) if position == "suffix" else F.concat(F.lit(style + ", "), p)
    return F.when(F.contains(F.lower(p), F.lit(style.lower())), p).otherwise(joined)


def text_list(json_or_text: Column, splits: bool = True) -> Column:
    """A value as a list of clean texts: a JSON array's elements (objects by their text), else the text, parted at commas
    and semicolons if `splits`."""
    s = clean_text(json_or_text)
    items = F.from_json(json_or_text, "array<string>")
    items = F.transform(items, lambda x: F.coalesce(F.get_json_object(F.when(x.startswith("{"), x), "$.text"), x))
    own = F.split(s, "[,;]") if splits else F.array(s)
    return F.filter(F.transform(F.when(s.startswith("[") & items.isNotNull(), items).otherwise(own), clean_text), lambda x: x != "")


def entities(json_or_text: Column) -> Column:
    """struct<texts, roles> of named entities: texts as they stand, or objects with a text and a role_in_title, else a role."""
    s = clean_text(json_or_text)
    items = F.from_json(json_or_text, "array<string>")
    own = F.when(s.startswith("[") & items.isNotNull(), items).otherwise(F.array(s))
    is_object = lambda x: F.coalesce(x.startswith("{"), F.lit(False))
    get = lambda x, k: clean_text(F.get_json_object(x, f"$.{k}"))
    texts = F.transform(own, lambda x: F.when(is_object(x), get(x, "text")).otherwise(clean_text(x)))
    roles = F.transform(F.filter(own, is_object), lambda x: F.when(get(x, "role_in_title") != "", get(x, "role_in_title")).otherwise(get(x, "role")))
    full = lambda a: F.filter(a, lambda x: x != "")
    return F.struct(full(texts).alias("texts"), full(roles).alias("roles"))


def text_value(json_or_text: Column) -> Column:
    """A value as one text: a JSON array's non-empty elements joined by a comma and a space."""
    s = clean_text(json_or_text)
    items = F.from_json(json_or_text, "array<string>")
    return F.when(s.startswith("[") & items.isNotNull(), F.array_join(F.filter(F.transform(items, clean_text), lambda x: x != ""), ", ")).otherwise(s)


def plan_prompt(title: Column, required: Column, optional: Column, strategy: Column, framing: Column, abstractness: Column, head: list[str], tail: list[str]) -> Column:
    """A prompt from a plan: head, title, cues (required first, each once), strategy, abstractness, framing, tail."""
    some = lambda x, before="", after="": F.when(clean_text(x) != "", F.concat(F.lit(before), clean_text(x), F.lit(after)))
    spaced = lambda x: F.translate(x, "_", " ")
    cues = F.array_join(let(F.concat(required, optional), distinct_ignoring_case), ", ")
    parts = [*map(F.lit, head), some(title, "about "), some(cues), some(spaced(strategy), after=" visual strategy"), some(spaced(abstractness), after=" composition"), some(framing), *map(F.lit, tail)]
    return F.concat_ws(", ", *parts)


#: The words that negate what follows them.
NEGATORS = "no|not|without|avoid|avoiding|exclude|excluding|forbid|forbidden|free of"


def is_negated(text: Column, term: str, reach: int = 56) -> Column:
    """Whether some mention of the term, or of its plural or singular, follows a negator within `reach` characters or is
    followed by "free"; texts are lower case. One regular expression, so the JVM does it."""
    other = term[:-1] if term.endswith("s") else term + "s"
    either = rf"\b(?:{term}|{other})\b"
    return text.rlike(rf"\b(?:{NEGATORS})\b.{{0,{reach - 2}}}{either}|{either}\s*[- ]?free\b")
