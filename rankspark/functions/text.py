"""Text functions.

The forms that SQL can express are column expressions and stay in the JVM; what
needs an HTML parser or Unicode tables is an Arrow-batched pandas UDF.  Nulls
stay null unless a function says otherwise; texts of any length are taken whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import Column
from pyspark.sql import types as T


# The marks of scores in a title, in front and at the end.
FRONT_MARK, END_MARK = r"\[\d+\]\s*", r"\s*\(TS:\s*\d+\)\s*$"


def clean_title(title: Column) -> Column:
    """Every ``[n]`` goes, and the last ``(TS: n)`` at the end; digits of any script count."""
    return F.regexp_replace(F.regexp_replace(title, f"(?U){FRONT_MARK}", ""), f"(?U){END_MARK}", "")


def collapse_whitespace(text: Column) -> Column:
    """Runs of white space (of any script) to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def strip_markup(text: Column) -> Column:
    """HTML to text by patterns: comments, scripts, styles and tags become blanks; entities stay."""
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<[^>]*>"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


class _Text(HTMLParser):
    """Text nodes outside scripts, styles and templates."""

    HIDDEN = ("script", "style", "template")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in self.HIDDEN and self.hidden > 0

    def handle_data(self, data: str) -> None:
        if not self.hidden and not data.isspace():
            self.parts.append(data.strip())


def html_to_text(source: str) -> str:
    """The text of a (loosely closed) HTML source, its nodes joined by blanks, white space collapsed."""
    if "<" not in source:
        return " ".join((html.unescape(source) if "&" in source else source).split())
    parser = _Text()
    parser.feed(source)
    parser.close()
    return " ".join(" ".join(parser.parts).split())


# ASCII spellings of letters and signs that Unicode doesn't decompose.
ASCII = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th",
    "œ": "oe", "Œ": "OE", "ı": "i", "‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "«": "<<", "»": ">>", "–": "-", "—": "--",
    "…": "...", "·": "*", "•": "*", "£": "PS", "€": "EUR", "°": "deg", "©": "(c)", "®": "(r)", "™": "(tm)",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": '"', "ы": "y", "ь": "'",
    "э": "e", "ю": "iu", "я": "ia", "№": "No.",
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x",
    "ο": "o", "π": "p", "ρ": "r", "σ": "s", "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
_SPACES = re.compile(r"[^\S\n]+")


def transliterate(text: str) -> str:
    """ASCII spelling; letters without one are dropped."""
    if text.isascii():
        return text
    out = []
    for c in unicodedata.normalize("NFC", text):
        if c < "\x80":
            out.append(c)
        elif c in ASCII:
            out.append(ASCII[c])
        elif c.lower() in ASCII:
            out.append(ASCII[c.lower()].capitalize())
        else:
            out += [x if x < "\x80" else ASCII.get(x, "") for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
    return "".join(out)


def normalise(text: str) -> str:
    """Lower-case ASCII with single blanks and line breaks kept single."""
    lines = (_SPACES.sub(" ", line).strip() for line in transliterate(text).lower().replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    return "\n".join(line for line in lines if line)


def _pandas(function: Callable[[str], str]):
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else function(t))

    return run


strip_html = _pandas(html_to_text)
normalise_text = _pandas(normalise)


def single_blob(title: Column, content: Column) -> Column:
    """Cleaned title and content as one text: markup removed, normalised.  Null parts count as empty."""
    both = F.concat(F.coalesce(clean_title(title), F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
    return normalise_text(collapse_whitespace(strip_html(both)))


def legacy_text(title: Column, content: Column) -> Column:
    """The form before :func:`single_blob`: the title keeps its marks."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
    return normalise_text(strip_html(both))


Tokenize, Detokenize = Callable[[str], list], Callable[[list], str]


def head_tokens(tokens: list, n: int) -> list:
    return tokens[:n] if n > 0 else []


def title_head_text(title: str | None, content: str | None, budget: int, separator: str = "", tokenize: Tokenize = str.split, detokenize: Detokenize = " ".join) -> str:
    """Title first, body in what is left of the token budget (four tokens go to the markers).

    Of a budget of four or less only one title token comes out.  The title keeps
    its markup.  The tokenizer is a parameter; words are the default.
    """
    marks = re.sub(END_MARK, "", re.sub(FRONT_MARK, "", title or ""))
    head = normalise(" ".join(marks.split()))
    if budget <= 4:
        return detokenize(head_tokens(tokenize(head), 1))
    top = head_tokens(tokenize(head), budget - 4)
    body = head_tokens(tokenize(normalise(html_to_text(content or ""))), budget - 4 - len(top))
    return (f" {separator} " if separator else " ").join(t for t in (detokenize(top), detokenize(body)) if t)


def title_head(budget: int, separator: str = "", tokenize: Tokenize = str.split, detokenize: Detokenize = " ".join) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(T.StringType())
    def run(titles: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([title_head_text(t, c, budget, separator, tokenize, detokenize) for t, c in zip(titles, contents)], dtype=object)

    return run


def word_head(text: Column, n: Column | int) -> Column:
    """The first ``n`` words (none if ``n`` is 0 or less), in the JVM."""
    n = F.lit(n) if isinstance(n, int) else n
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.when(n > 0, F.slice(words, F.lit(1), F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<string>")), " ")


def title_head_words(title: Column, content: Column, budget: int) -> Column:
    """:func:`title_head_text` over plain words, without normalisation, as one JVM expression."""
    head, body = collapse_whitespace(clean_title(F.coalesce(title, F.lit("")))), strip_markup(F.coalesce(content, F.lit("")))
    if budget <= 4:
        return word_head(head, 1)
    top = word_head(head, budget - 4)
    used = F.size(F.filter(F.split(top, " "), lambda w: w != ""))
    return F.trim(F.concat_ws(" ", F.nullif(top, F.lit("")), F.nullif(word_head(body, F.lit(budget - 4) - used), F.lit(""))))


def prepared(mode: str, title: Column, content: Column, budget: int = 2048) -> Column:
    if mode == "single_blob":
        return single_blob(title, content)
    if mode == "title_head":
        return title_head(budget)(title, content)
    raise ValueError(f"unknown text preparation: {mode!r}")


def text_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in hexadecimal."""
    return F.sha2(text, 256)


def prompt(template: str, title: Column, content: Column) -> Column:
    """The template with ``{title}`` and ``{content}`` filled in; nulls count as empty."""
    filled = F.replace(F.lit(template), F.lit("{title}"), F.coalesce(title, F.lit("")))
    return F.replace(filled, F.lit("{content}"), F.coalesce(content, F.lit("")))


def prompt_content(content: Column, window: int, template_words: int, title_words: Column, answer_words: int) -> Column:
    """The words of the content that fit a model's window beside template, title and answer; none if nothing is left."""
    return word_head(content, F.lit(window - template_words - answer_words) - title_words)
