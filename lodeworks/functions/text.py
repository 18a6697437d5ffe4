"""Scalar expressions over text: all native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings of a model's reply that carry no content.
PREAMBLES = ("here's", "here is", "sure", "certainly", "of course", "below is", "below are", "the following")
#: Phrases of the reading prompt; two of them in a reply mean that it only echoes the prompt.
ECHOES = ("read all text in this image", "output each text item", "no explanations", "extract every visible text string", "one item per line", "nothing else")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, worked out once for a row however often body uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (trim only takes spaces)."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def normalise_space(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"\s+", " ")


def words(c: Column) -> Column:
    """White-space tokens, none of them empty."""
    return F.filter(F.split(strip(c), r"\s+"), lambda w: w != "")


def query_tokens(c: Column) -> Column:
    """Normalised tokens of more than three characters."""
    return F.filter(words(c), lambda w: F.length(w) > 3)


def context_prefix(stem: Column, section: Column | None = None, page: Column | None = None) -> Column:
    """[Document: s | Section: t | Page: n], with what there is."""
    parts = [F.concat(F.lit("Document: "), stem)]
    if section is not None:
        parts.append(F.when(section != "", F.concat(F.lit("Section: "), section)))
    if page is not None:
        parts.append(F.concat(F.lit("Page: "), page.cast("string")))
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]"))


#: Function words that tell languages apart, a few of each.
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "das", "nicht", "ist", "mit", "ein", "den", "von"),
    "en": ("the", "and", "of", "to", "is", "in", "that", "for", "it", "with"),
    "es": ("el", "la", "que", "de", "los", "y", "en", "una", "por", "con"),
    "fr": ("le", "les", "des", "et", "est", "une", "que", "dans", "pour", "pas"),
}


def detect_language(c: Column) -> Column:
    """A guess of the language code from letters and function words; en where nothing tells. A stand-in for a detector."""

    def hits(tokens: Column, code: str) -> Column:
        known = F.filter(tokens, lambda w: w.isin(*LANGUAGE_WORDS[code]))
        return F.struct(F.size(known).alias("n"), F.lit(code).alias("code"))

    def most(tokens: Column) -> Column:
        best = F.greatest(*(hits(tokens, code) for code in LANGUAGE_WORDS))
        return F.when(best["n"] > 0, best["code"]).otherwise("en")

    han = F.length(F.regexp_replace(c, r"[^\p{IsHan}]", ""))
    kana = c.rlike(r"[\p{IsHiragana}\p{IsKatakana}]")
    return F.when(kana, "ja").when(han * 5 >= F.length(c), F.when(han > 0, "zh").otherwise("en")).otherwise(let(words(F.lower(c)), most))


def language_tag(code: Column) -> Column:
    """Upper-case code; any Chinese is ZH-TW, none is EN."""
    return F.when(code.isNull() | (code == ""), "EN").when(F.lower(code).startswith("zh"), "ZH-TW").otherwise(F.upper(code))


def strip_preamble(c: Column) -> Column:
    """Without the leading lines that open with a preamble."""

    def opens(line: Column) -> Column:
        return F.exists(F.array(*map(F.lit, PREAMBLES)), lambda p: F.startswith(line, p))

    def rest(lines: Column) -> Column:
        plain = F.transform(lines, lambda line: ~let(F.lower(strip(line)), opens))
        first = F.array_position(plain, True)
        return F.when(first == 0, "").otherwise(strip(F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n")))

    return let(F.split(c, "\n"), rest)


def dedup_lines(c: Column) -> Column:
    """Without blank lines and without lines that equal the one kept before."""
    lines = F.filter(F.split(c, "\n"), lambda line: strip(line) != "")
    return F.array_join(let(lines, lambda kept: F.filter(kept, lambda line, i: (i == 0) | (line != F.get(kept, i - 1)))), "\n")


def is_echo(c: Column) -> Column:
    return sum((F.lower(c).contains(p).cast("int") for p in ECHOES), F.lit(0)) >= 2


def json_array(reply: Column) -> Column:
    """The JSON array in a model's reply: without fences, from the first [ to the last ]; null if there is none."""
    bare = strip(F.regexp_replace(strip(F.regexp_replace(reply, r"```[a-z]*", "")), r"^`+|`+$", ""))
    found = F.regexp_extract(bare, r"(?s)\[.*\]", 0)
    # a reply that is an object as a whole is no list, whatever lists it holds
    return F.when((found != "") & ~(bare.startswith("{") & F.try_parse_json(bare).isNotNull()), found)


def stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]*)$", 1))


def is_garbage_entity(name: Column) -> Column:
    """Too short, markup, several lines, fewer than two letters, or a plain number."""
    s = strip(name)
    letters = F.length(F.regexp_replace(s, r"[^\p{L}]", ""))
    return (F.length(s) < 3) | s.startswith("#") | s.contains("|") | s.contains("\n") | (letters < 2) | F.regexp_replace(s, r"[,.\-]", "").rlike(r"^\p{Nd}+$")


def title_label(name: Column) -> Column:
    """A node's name as a label: underscores to spaces, each word with a capital."""
    return F.initcap(F.regexp_replace(name, "_", " "))


def first_lines(reply: Column, n: int) -> Column:
    """The first n lines of a reply that aren't blank, stripped."""
    return F.slice(F.filter(F.transform(F.split(reply, "\n"), strip), lambda x: x != ""), 1, n)


def data_uri_bytes(uri: Column) -> Column:
    """The bytes of a base64 data URI; null for anything else."""
    body = F.regexp_extract(uri, r"(?s)^data:[^,]*,(.*)$", 1)
    return F.when(uri.startswith("data:") & uri.contains(","), F.try_to_binary(body, F.lit("base64")))


def needs_graph(reply: Column) -> Column:
    return F.upper(strip(reply)).startswith("NO")


def unit_hint(name: Column) -> Column:
    """The unit that a metric's name states: after unit: or unit=, else what else stands in parentheses beside the word."""
    named = F.regexp_extract(name, r"(?i)unit\s*[:=]\s*([^)\],;]+)", 1)
    around = F.regexp_extract(name, r"(?i)\(([^)]*unit[^)]*)\)", 1)
    rest = strip(F.regexp_replace(around, r"(?i)unit\s*[:=]?\s*", ""))
    return F.when(name.rlike(r"(?i)unit\s*[:=]\s*[^)\],;]+"), strip(named)).when(rest != "", rest)
