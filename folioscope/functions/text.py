"""Tokenizers, case folding and text cleaning as column expressions."""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------------
RANKING_WORD = r"[a-z][a-z0-9-]{2,}"
PROFILE_WORD = r"[A-Za-z][A-Za-z0-9-]{2,31}"
LINK = (
    r"(?iU)(?:\bhttps?://|\bwww\.)[^\s<>\"]+"
    r"|\b(?:github|gitlab|bitbucket)\.com/[^\s<>\"]+"
)
SENSITIVE_TERM = r"(?i)(?:sk-[A-Za-z0-9]{12,}|ghp_[A-Za-z0-9]{12,}|password|secret)"
STOP_WORDS = [
    "about", "abstract", "and", "are", "for", "from", "github", "into", "gitlab", "bitbucket",
    "com", "doi", "http", "https", "note", "net", "org", "paper", "that", "the", "this", "www",
    "with",
]
STOCK_REASONS = [
    "this paper is relevant to your interests.",
    "this is a relevant paper for you.",
    "this paper is relevant.",
    "this is a useful paper.",
]
SECTION_TERMS = {
    "method": ["method", "approach", "algorithm", "model"],
    "evaluation": ["experiment", "evaluation", "implementation", "result"],
    "limitations": ["limitation", "discussion", "threat", "future work"],
}
SECTION_CHARACTERS = 4_000
TOTAL_CHARACTERS = 10_000
COMMON_ENTITIES = {
    "&nbsp;": "\u00a0", "&copy;": "\u00a9", "&middot;": "\u00b7", "&quot;": '"', "&apos;": "'",
    "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&",
}
# -------------------------------------------------------------------------------------------

TAG = r"(?s)<(?:[A-Za-z/!?][^>]*)(?:>|\z)"
ANY_ENTITY = r"&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?"
#: Entities that the column expressions leave to Python.
RARE_ENTITY = r"&(?!(?:nbsp|copy|middot|quot|apos|#39|lt|gt|amp);)#?[A-Za-z0-9]"
#: Characters that NFKC may change; Latin letters outside this class stay what they are.
NOT_NFKC_SAFE = r"[^\x00-\x7F\u00A9\u00AB\u00B0\u00B7\u00BB\u00C0-\u0131]"

#: Markup that the column expressions cannot tell for certain, so the page is parsed in Python:
#: ``<`` or ``>`` inside a tag's quotes (or more quotes than are followed), names that only begin
#: like the ones looked for, and end tags that hold more than a name.
UNSURE_TAG = (
    r"(?i)<[A-Za-z/][^<>\"']*+(?:\"[^\"<>]*+\"[^<>\"']*+|'[^'<>]*+'[^<>\"']*+){0,100}+[\"'<]"
    r"|</?(?:script|style|nav|div|p|li|br|h[1-6])[^A-Za-z0-9_\s/>]"
    r"|</(?:script|style|nav|h[1-6])\b(?!\s*>)|<!\["
)
HIDDEN = r"(?i)<(?:script|style)\b"

# Characters whose full case folding adds ASCII letters that ``lower`` leaves alone; found by
# rule, so the list follows the Unicode tables of the running Python.
_ASCII = re.compile(r"[a-z]")
FOLD_EXTRAS = {
    char: char.casefold()
    for char in map(chr, range(0x80, 0xFB10))
    if char.lower() == char and char.casefold() != char and _ASCII.search(char.casefold())
}
SHARP_S = "\u00df"


def ascii_fold(text: Column) -> Column:
    """Case folding that is exact for every ASCII letter it yields, without leaving the JVM.

    Sharp s is common and replaced at once. The other characters are looked for only in texts that hold
    any between the first and the last of them: a class of one range costs a comparison a character,
    the class of all of them one for each member.
    """
    rare = {char: folded for char, folded in FOLD_EXTRAS.items() if char != SHARP_S}
    lowered = F.replace(F.lower(text), F.lit(SHARP_S), F.lit(FOLD_EXTRAS[SHARP_S]))
    replaced = lowered
    for char, folded in rare.items():
        replaced = F.replace(replaced, F.lit(char), F.lit(folded))
    near = lowered.rlike(f"[{min(rare)}-{max(rare)}]")
    return F.when(near & lowered.rlike("[" + "".join(rare) + "]"), replaced).otherwise(lowered)


def ranking_words(text: Column) -> Column:
    """Every ranking token of a text, in order, repeats kept (I8)."""
    return F.regexp_extract_all(ascii_fold(text), F.lit(RANKING_WORD), F.lit(0))


def ranking_terms(text: Column) -> Column:
    """The distinct ranking tokens of a text."""
    return F.array_distinct(ranking_words(text))


def facet_tokens(value: Column) -> Column:
    """Tokens of a facet label; hyphens and spaces mean the same."""
    return ranking_terms(F.replace(value, F.lit("-"), F.lit(" ")))


def is_safe_term(term: Column) -> Column:
    """True unless the term looks like a credential."""
    return ~term.rlike(SENSITIVE_TERM)


def profile_tokens(text: Column) -> Column:
    """Profile tokens, in order with repeats: links, stop words and sensitive words dropped."""
    words = F.regexp_extract_all(F.regexp_replace(text, LINK, " "), F.lit(PROFILE_WORD), F.lit(0))
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(
        F.transform(words, F.lower),
        lambda w: ~F.array_contains(stop, w) & is_safe_term(w),
    )


def collapse_space(text: Column) -> Column:
    """Runs of white space become one space, ends trimmed."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def is_generic_reason(reason: Column) -> Column:
    """Stock phrase, or fewer than five distinct alphabetic words; other scripts pass."""
    folded = F.regexp_replace(ascii_fold(reason), r"(?U)^\s+|\s+$", "")
    words = F.filter(
        F.split(F.replace(folded, F.lit("-"), F.lit(" ")), r"(?U)\s+"),
        lambda w: w.rlike(r"^\p{L}+$"),
    )
    return folded.rlike("[a-z]") & (
        folded.isin(STOCK_REASONS) | (F.size(F.array_distinct(words)) < 5)
    )


@F.pandas_udf(T.StringType())
def nfkc_casefold(values: pd.Series) -> pd.Series:
    """NFKC then case folding."""
    return values.map(
        lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold()
    )


def _identity(value: str) -> str:
    folded = unicodedata.normalize("NFKC", value).casefold()
    return " ".join(re.sub(r"\W+", " ", folded).split())


@F.pandas_udf(T.ArrayType(T.StringType()))
def _identities_any_script(values: pd.Series) -> pd.Series:
    return values.map(lambda names: None if names is None else [_identity(n) for n in names])


def normalized_identities(names: Column) -> Column:
    """Names ready for exact comparison.

    Plain ASCII rows never leave the JVM; only rows with other characters pass through Arrow.
    """
    plain = F.forall(names, lambda n: n.rlike(r"^[\x00-\x7F]*$"))
    native = F.transform(
        names,
        lambda n: F.trim(F.regexp_replace(F.lower(n), "[^a-z0-9_]+", " ")),
    )
    return F.coalesce(
        F.when(plain, native), _identities_any_script(F.when(~plain, names))
    )


def _named_entity(match: re.Match) -> str:
    found = html.unescape(match.group())
    return match.group() if found in ("<", ">", "&") else found


@F.pandas_udf(T.ArrayType(T.StringType()))
def _rare_entities(values: pd.Series) -> pd.Series:
    """Entities outside ``COMMON_ENTITIES``; those that would read as markup stay."""
    return values.map(
        lambda items: None if items is None
        else [None if v is None else re.sub(ANY_ENTITY, _named_entity, v) for v in items]
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(
        lambda items: None if items is None
        else [None if v is None else unicodedata.normalize("NFKC", v) for v in items]
    )


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def _where(items: Column, pattern, udf) -> Column:
    """Arrays with an element that matches (a pattern, or a condition on the element) go through
    ``udf``; all others stay as they are. ``udf`` returns null for null alone."""
    matches = pattern if callable(pattern) else lambda v: v.rlike(pattern)
    return F.coalesce(udf(_let(items, lambda given: F.when(F.exists(given, matches), given))), items)


class _Page(HTMLParser):
    """``(kind, payload)`` of every tag and text of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        self.found.append(("open", tag))

    def handle_endtag(self, tag: str) -> None:
        self.found.append(("close", tag))

    def handle_data(self, data: str) -> None:
        self.found.append(("text", data))


def _shown(page: str, hidden: tuple[str, ...]) -> list[tuple[str, str]]:
    """Tags and texts of a page outside the elements ``hidden``."""
    parser = _Page()
    parser.feed(page)
    parser.close()
    shown, depth = [], 0
    for kind, payload in parser.found:
        if kind != "text" and payload in hidden:
            depth = depth + 1 if kind == "open" else max(0, depth - 1)
        elif not depth or (kind != "text" and re.fullmatch("h[1-6]", payload) and "nav" in hidden):
            shown.append((kind, payload))
    return shown


def _escaped(text: str) -> str:
    return html.escape(text, quote=False)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parsed_text(values: pd.Series) -> pd.Series:
    """Pages as their visible text, with spaces for block tags; no markup is left, signs are escaped."""
    def visible(page: str) -> str:
        return "".join(
            _escaped(payload) if kind == "text"
            else " " if payload in ("div", "p", "li") or (payload == "br" and kind == "open") else ""
            for kind, payload in _shown(page, ("script", "style")))

    return values.map(
        lambda items: None if items is None else [None if v is None else visible(v) for v in items])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _parsed_sections(values: pd.Series) -> pd.Series:
    """Pages as headings and texts alone, without what is never shown; signs are escaped."""
    def plain(page: str) -> str:
        return "".join(
            f"<i>{_escaped(payload)}</i>" if kind == "text"
            else f"<{'/' * (kind == 'close')}{payload}>" if re.fullmatch("h[1-6]", payload) else ""
            for kind, payload in _shown(page, ("script", "style", "nav")))

    return values.map(
        lambda items: None if items is None else [None if v is None else plain(v) for v in items])


def _unsure(page: Column, sections: bool = False) -> Column:
    """Whether only a parser can tell what a page shows."""
    def inside(start: str, end: str, what: str, or_open: bool = False) -> Column:
        held = lambda v: F.split(v, end)[0].rlike(what)
        return _let(F.split(page, start), lambda parts: F.exists(
            F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
            lambda v: (~v.rlike(end) | held(v)) if or_open else held(v)))

    found = (
        page.rlike(UNSURE_TAG) | inside(HIDDEN, r"(?i)</(?:script|style)\s*>", "<!--")
        | inside("<!--", "-->", HIDDEN))
    # Navigation that is nested, not ended, or holds scripts.
    return found | inside(r"(?i)<nav\b", r"(?i)</nav\s*>", HIDDEN, True) if sections else found


def _without(text: Column, *elements: str, comment: str = "") -> Column:
    """HTML with ``comment`` for comments and without these elements and what they hold."""
    names = "|".join(elements)
    bare = F.regexp_replace(text, r"(?s)<!--.*?(?:-->|\z)", comment)
    return F.regexp_replace(bare, rf"(?is)<({names})\b[^>]*>.*?(?:</\1\s*>|\z)", "")


def _unescaped(text: Column) -> Column:
    for name, char in COMMON_ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def html_to_texts(items: Column) -> Column:
    """Visible text of every HTML string of an array: script and style dropped, block tags
    separate words, entities and compatibility forms resolved (I10, U2)."""
    def visible(raw: Column) -> Column:
        spaced = F.regexp_replace(
            _without(raw, "script", "style"), r"(?i)</?(?:div|p|li)\b[^>]*>|<br\b[^>]*>", " ")
        return F.regexp_replace(spaced, TAG, "")

    # Pages that only a parser can read come back from it without markup.
    sure = _where(items, lambda v: _unsure(v), _parsed_text)
    bare = _where(F.transform(sure, visible), RARE_ENTITY, _rare_entities)
    plain = _where(F.transform(bare, _unescaped), NOT_NFKC_SAFE, _nfkc)
    return F.transform(plain, collapse_space)


def html_to_text(text: Column) -> Column:
    """``html_to_texts`` of one string; null is empty."""
    return html_to_texts(F.array(F.coalesce(text, F.lit(""))))[0]


def paper_sections(
    text, section_characters: int | None = SECTION_CHARACTERS,
    total_characters: int | None = TOTAL_CHARACTERS,
) -> Column:
    """Method, evaluation and limitation text of a paper's HTML.

    The page is split at its headings; each part belongs to the section its heading names first.
    Pieces of text between tags are then added up in order, within a bound for each section and one
    for all; ``None`` sets no bound.
    """
    raw = F.col(text) if isinstance(text, str) else text
    sure = _where(
        F.array(F.coalesce(raw, F.lit(""))), lambda v: _unsure(v, sections=True), _parsed_sections)[0]
    # A comment ends a piece of text, as any tag does.
    page = _without(sure, "script", "style", "nav", comment="<!>")
    page = _where(F.array(page), RARE_ENTITY, _rare_entities)[0]
    clean = lambda v: collapse_space(_unescaped(v))
    after = F.split(page, r"(?i)<h[1-6]\b[^>]*>")
    kinds = list(SECTION_TERMS)

    none = F.array().cast("array<struct<kind:string,text:string>>")

    def pieces(part: Column) -> Column:
        heading = F.regexp_extract(part, r"(?is)\A(.*?)</h[1-6]\s*>", 1)
        kind = _let(F.lower(clean(F.regexp_replace(heading, TAG, " "))), lambda label: F.coalesce(*[
            F.when(label.rlike("|".join(SECTION_TERMS[name])), F.lit(name)) for name in kinds]))
        body = F.regexp_replace(part, r"(?is)\A.*?</h[1-6]\s*>", "")
        texts = F.filter(F.transform(F.split(body, TAG), clean), lambda v: v != "")
        named = part.rlike(r"(?is)</h[1-6]\s*>")
        return _let(kind, lambda known: F.when(named & known.isNotNull(), F.transform(
            texts, lambda v: F.struct(known.alias("kind"), v.alias("text")))).otherwise(none))

    found = F.flatten(_let(after, lambda parts: F.transform(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), pieces)))
    most = section_characters if section_characters is not None else 2**31 - 1
    total = total_characters if total_characters is not None else 2**31 - 1
    start = F.struct(F.lit(0).alias("all"), *[
        F.struct(F.lit("").alias("text"), F.lit(0).alias("size")).alias(name) for name in kinds])

    def add(state: Column, piece: Column) -> Column:
        size = F.coalesce(*[F.when(piece["kind"] == name, state[name]["size"]) for name in kinds])
        room = F.greatest(F.least(F.lit(most) - size, F.lit(total) - state["all"]), F.lit(0))
        kept = F.substring(piece["text"], F.lit(1), room)
        grown = lambda old: F.struct(
            F.when(kept == "", old["text"]).otherwise(F.concat(old["text"], F.lit(" "), kept)).alias("text"),
            (old["size"] + F.char_length(kept)).alias("size"))
        return F.struct((state["all"] + F.char_length(kept)).alias("all"), *[
            F.when(piece["kind"] == name, grown(state[name])).otherwise(state[name]).alias(name)
            for name in kinds])

    text_of = lambda state, name: F.nullif(collapse_space(state[name]["text"]), F.lit(""))
    return F.aggregate(found, start, add, lambda state: F.struct(
        *[text_of(state, name).alias(name) for name in kinds]))


# Functions travel to the workers by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
