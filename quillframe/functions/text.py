"""Lexing, normalising, masking and classifying text, as Column functions.

Patterns are shared with the SQL equivalents: no look-around, and literals are
unrolled so that long ones do not recurse.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import vocabulary as V
from quillframe.shared import ship

HIGH = r"\x{80}-\x{10FFFF}"
NAME = rf"[A-Za-z_${HIGH}][A-Za-z_${HIGH}0-9]*"
_LITERALS = [rf"{q}[^{q}\\{stop}]*(?:\\(?:[\s\S]|$)[^{q}\\{stop}]*)*{q}?" for q, stop in (('"', r"\n"), ("'", r"\n"), ("`", ""))]
TOKEN = "|".join(
    [r"\r", r"\n", r"[ \t]+", "//", "#", r"/\*", r"\*/", *_LITERALS, NAME, rf"[0-9][A-Za-z_${HIGH}0-9.]*", *("".join("\\" + c if c in "+*?.|^" else c for c in op) for op in V.OPERATORS), r"[\s\S]"]
)
#: What a text has whose blanks are not all single spaces within lines; without it the matches are the tokens.
UNEVEN = r"[\t\r]|  |(?:^|\n) | (?:\n|$)"
END = "<eof>"
MARK = "\x02"
#: Texts with more backslashes than this are lexed outside the JVM, whose regular expressions recurse on escapes.
MANY_ESCAPES = 500


def tokens(text: Column, end: bool = True) -> Column:
    """The token array of ``text``: line ends, indents, single spaces, literals, names, numbers, operators, then ``<eof>``.

    Carriage returns are dropped; a run of spaces and tabs is kept at the start
    of a line that has more than that, dropped if it has not, and is one space
    elsewhere. Only for texts with at most MANY_ESCAPES backslashes; see
    ``with_tokens``. Null stays null.
    """
    found = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(0))
    raw = F.filter(found, lambda t: t != "\r")

    def tidy(arr: Column) -> Column:
        def one(t: Column, i: Column) -> Column:
            before, after = F.get(arr, i - 1), F.get(arr, i + 1)
            blank = F.substring(t, 1, 1).isin(" ", "\t")
            at_start = before.isNull() | (before == "\n")
            return F.when(~blank, t).when(at_start & (after.isNull() | (after == "\n")), F.lit("")).when(at_start, t).otherwise(F.lit(" "))

        return F.filter(F.transform(arr, one), lambda t: t != "")

    # Bound to a lambda variable, the matches are found once and not for every token.
    out = F.when(text.rlike(UNEVEN), F.get(F.transform(F.array(raw), tidy), F.lit(0))).otherwise(found)
    return F.concat(out, F.array(F.lit(END))) if end else out


_PYTHON_TOKEN = re.compile(TOKEN.replace(HIGH, "\\u0080-\\U0010FFFF"))
_PYTHON_UNEVEN = re.compile(UNEVEN)


def lex(text: str | None, end: bool = True) -> list[str] | None:
    """``tokens`` for one text in Python, without a limit on escapes."""
    if text is None:
        return None
    raw = _PYTHON_TOKEN.findall(text)
    if not _PYTHON_UNEVEN.search(text):
        return raw + [END] if end else raw
    raw = [t for t in raw if t != "\r"]
    out = []
    for i, t in enumerate(raw):
        if t[0] in " \t":
            if i == 0 or raw[i - 1] == "\n":
                if i + 1 == len(raw) or raw[i + 1] == "\n":
                    continue
            else:
                t = " "
        out.append(t)
    return out + [END] if end else out


def with_tokens(df: DataFrame, text: str = "text", name: str = "toks") -> DataFrame:
    """``df`` with a token column; rows with very many escapes are lexed in Arrow batches.

    Lexing is the costly step of all that reads tokens. A filter on the column,
    also one that Spark infers of an inner generator, would be moved below and
    lex each text anew; nothing moves below the outer generator of one row.
    """
    ship(df.sparkSession)
    escapes = F.coalesce(F.length(text) - F.length(F.replace(F.col(text), F.lit("\\"), F.lit(""))), F.lit(0))
    plain = df.where(escapes <= MANY_ESCAPES).select(*[c for c in df.columns if c != name], F.explode_outer(F.array(tokens(F.col(text)))).alias(name))

    @F.arrow_udf("array<string>")
    def slow(texts: pa.Array) -> pa.Array:
        return pa.array([lex(t.as_py()) for t in texts], pa.list_(pa.string()))

    return plain.unionByName(df.where(escapes > MANY_ESCAPES).withColumn(name, slow(F.col(text))))


def first_line_token(line: Column) -> Column:
    """The first of ``line_tokens`` of a normalised line; only it is sought."""
    return F.nullif(F.regexp_extract(F.regexp_extract(line, r"^[ \t]*([^\n]*)", 1), f"(?:{TOKEN})", 0), F.lit(""))


def detok(toks: Column) -> Column:
    """The text of a token array."""
    return F.array_join(F.filter(toks, lambda t: t != END), "")


def line_tokens(line: Column) -> Column:
    """Tokens of a line, without indent, up to its end."""
    return tokens(F.regexp_extract(line, r"^[ \t]*([^\n]*)", 1), end=False)


def is_name(tok: Column) -> Column:
    """A name of at least two bytes."""
    return tok.rlike(rf"^[A-Za-z_${HIGH}]") & (F.octet_length(tok) >= 2)


def is_keyword(tok: Column) -> Column:
    return tok.isin(list(V.KEYWORD_CLASS))


def keyword_class(tok: Column) -> Column:
    """Class 1 to 7 of a keyword; null for other tokens."""
    out = F.when(F.lit(False), F.lit(0))
    for k, words in V.KEYWORDS.items():
        out = out.when(tok.isin(words), F.lit(k))
    return out


def normalize(line: Column) -> Column:
    """Without indent and trailing blanks, inner runs of blanks as one space."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(line, r"^[ \t]+", ""), r"[ \t\r]+", " "))


def document_lines(text: Column, least: int = 4) -> Column:
    """Normalised lines of at least ``least`` bytes."""
    return F.filter(F.transform(F.split(text, "\n"), normalize), lambda x: F.octet_length(x) >= least)


def masked(toks: Column) -> Column:
    """Tokens with every name that is no keyword replaced by a mark."""
    return F.transform(toks, lambda t: F.when(t.rlike(rf"^[A-Za-z_${HIGH}][A-Za-z_${HIGH}0-9-]*$") & ~is_keyword(t), MARK).otherwise(t))


def masked_line(line: Column) -> Column:
    return F.array_join(masked(line_tokens(line)), "")


def subtokens(name: Column) -> Column:
    """Parts of a name: cut before ``_`` and ``-``, between letters and digits, at case changes and after acronyms.

    The parts joined are the name.
    """
    cut = "\x01"
    x = F.regexp_replace(name, r"([_-])", cut + "$1")
    x = F.regexp_replace(x, r"([a-z])([A-Z])", "$1" + cut + "$2")
    x = F.regexp_replace(x, r"([A-Z])([A-Z][a-z])", "$1" + cut + "$2")
    x = F.regexp_replace(x, r"([0-9])([A-Za-z])", "$1" + cut + "$2")
    x = F.regexp_replace(x, r"([A-Za-z])([0-9])", "$1" + cut + "$2")
    return F.filter(F.split(x, cut), lambda p: p != "")


def name_key(parts: Column) -> Column:
    """Parts without separators, ASCII letters lower-cased, joined by ``|``."""
    low = F.transform(parts, lambda p: F.translate(F.regexp_replace(p, r"^[_-]+", ""), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_join(F.filter(low, lambda p: p != ""), "|")


def language_of(path: Column) -> Column:
    """Language bucket of a path or URI by file name and extension; ``other`` for the rest."""
    p = F.regexp_replace(path, r"^[\s\S]*?://", "")
    p = F.regexp_extract(p, r"^[^?#]*", 0)
    base = F.lower(F.regexp_extract(p, r"([^/]*)/*$", 1))
    ext = F.regexp_extract(base, r"\.([^.]*)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for name, lang in V.LANGUAGE_NAMES.items():
        out = out.when(base == name, F.lit(lang))
    for lang, exts in V.LANGUAGE_EXTENSIONS.items():
        out = out.when(ext.isin(exts), F.lit(lang))
    return out.otherwise("other")


def embedded_language(base: Column, prefix: Column) -> Column:
    """Language at the end of ``prefix``: inside an open fence, ``<?php`` or ``<script``, else ``base``."""
    fences = F.regexp_extract_all(F.concat(F.lit("\n"), prefix), F.lit(r"\n```([^\n]*)"), F.lit(1))
    tag, fence = F.trim(F.get(fences, F.size(fences) - 1)), F.when(F.lit(False), F.lit(""))
    for t, lang in V.FENCES.items():
        fence = fence.when(tag == t, F.lit(lang))
    in_fence = F.when(F.size(fences) % 2 == 1, fence)
    php = F.substring_index(prefix, "<?php", -1)
    script = F.substring_index(prefix, "<script", -1)
    open_php = F.contains(prefix, F.lit("<?php")) & ~F.contains(php, F.lit("?>"))
    open_script = F.contains(prefix, F.lit("<script")) & ~F.contains(script, F.lit("</script"))
    markup = F.when(open_php, "php").when(open_script & F.contains(F.substring(script, 1, 193), F.lit("ts")), "typescript").when(open_script, "javascript")
    return F.when(base.isin("markdown", "md"), F.coalesce(in_fence, base)).when(base.isin("html", "svelte", "vue", "php"), F.coalesce(markup, base)).otherwise(base)


def infix_tail(prefix: Column) -> Column:
    """What follows the last ``(``, ``,`` or ``=`` of a line's start, if at least 4 bytes; else empty."""
    tail = F.trim(F.regexp_extract(F.rtrim(prefix), r"[(,=]([^(,=]*)$", 1))
    return F.when(F.octet_length(tail) >= 4, normalize(tail)).otherwise("")


def skippable_name(path: Column) -> Column:
    """True for lock files, bundles, generated code and other names that hold no source."""
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    out = base.isin(V.SKIP_FILES) | F.contains(base, F.lit("_generated."))
    for s in V.SKIP_SUFFIXES:
        out = out | F.endswith(base, F.lit(s))
    return out


def skippable_dir(path: Column) -> Column:
    """True if a folder of the path is hidden or is one of those that are not read."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(V.SKIP_DIRS) | (F.startswith(d, F.lit(".")) & ~d.isin(".", "..")))


def acceptable_text(text: Column) -> Column:
    """Not empty, too large, binary or generated, and without a line of over 500 bytes; cheap tests first."""
    head = F.substring(text, 1, 4096)
    generated = F.lit(False)
    for m in V.GENERATED_MARKS:
        generated = generated | F.contains(head, F.lit(m))
    long_line = F.exists(F.split(text, "\n"), lambda x: F.octet_length(x) > V.MAX_LINE_BYTES)
    fits = (F.octet_length(text) > 0) & (F.octet_length(text) <= V.MAX_FILE_BYTES)
    return F.coalesce(fits & (F.instr(F.substring(text, 1, 8192), "\x00") == 0) & ~generated & ~long_line, F.lit(False))


def acceptable_suggestion(suggestion: Column, tail: Column, rest: Column, least: int = 2) -> Column:
    """False for suggestions that are too short, blank, or repeat what follows the cursor.

    ``tail`` is the normalised text after the cursor, ``rest`` that of the line.
    """
    s = normalize(suggestion)
    n = F.octet_length(rest)
    ends = (s == rest) | F.endswith(s, rest)
    long_rest = F.when(ends, F.octet_length(s) > n).otherwise(~F.contains(s, rest))
    overlap = F.when(rest == "", True).when(n >= 2, long_rest).otherwise(~F.endswith(s, rest))
    return (F.octet_length(suggestion) >= least) & (s != "") & F.when(tail == "", True).otherwise(~F.startswith(tail, s) & overlap)


def foreign_line(line: Column, lang: Column) -> Column:
    """True if the first line holds a token or substring that ``lang`` cannot have."""
    first = F.substring_index(line, "\n", 1)
    out = F.lit(False)
    for name, words in V.FOREIGN_TOKENS.items():
        # Most lines hold none of the words even as a part; the pattern, with its ends outside the alternatives, is for the rest.
        whole, some = [w for w in words if not w.endswith(".")], F.lit(False)
        for w in whole:
            some = some | F.contains(first, F.lit(w))
        hit = some & first.rlike(rf"(?:^|[^A-Za-z0-9_$])(?:{'|'.join(whole)})(?:[^A-Za-z0-9_$]|$)")
        for w in words:
            if w.endswith("."):
                hit = hit | F.contains(first, F.lit(w))
        out = out | ((lang == name) & hit)
    for name, subs in V.FOREIGN_SUBSTRINGS.items():
        for s in subs:
            hit = F.contains(first, F.lit(s))
            if (name, s) == ("python", ":="):
                head = F.substring_index(first, ":=", 1)
                hit = hit & ~head.rlike(r"[(\[{]") & ~first.rlike(r"^[ \t]*(?:if|while|elif|for|return|assert) ")
            out = out | ((lang == name) & hit)
    return out


def indent_unit(text: Column, go: Column | None = None) -> Column:
    """The first indent of a text, a tab or at most 8 spaces; by default a tab for Go, else 4 spaces."""
    first = F.regexp_extract(text, r"(?:^|\n)(\t|[ ]{1,8})[^ \t\n]", 1)
    default = F.when(go, "\t").otherwise("    ") if go is not None else F.lit("    ")
    return F.when(first != "", first).otherwise(default)


def register(spark) -> None:
    """SQL functions: lex_tokens, normalize_line, masked_line, subtokens, by name, over Arrow."""

    ship(spark)

    def simple(name: str, fn, kind: str, to: pa.DataType) -> None:
        @F.arrow_udf(kind)
        def of(x: pa.Array) -> pa.Array:
            return pa.array([None if (v := t.as_py()) is None else fn(v) for t in x], to)

        spark.udf.register(name, of)

    tidy = lambda s: re.sub(r"[ \t\r]+", " ", re.sub(r"^[ \t]+", "", s)).rstrip(" ")
    name = re.compile(r"[A-Za-z_$\u0080-\U0010FFFF][A-Za-z_$\u0080-\U0010FFFF0-9-]*")
    shape = lambda s: "".join(MARK if name.fullmatch(t) and t not in V.KEYWORD_CLASS else t for t in lex(s.lstrip(" \t").split("\n")[0], end=False))
    cuts = [r"([_-])", r"([a-z])(?=[A-Z])", r"([A-Z])(?=[A-Z][a-z])", r"([0-9])(?=[A-Za-z])", r"([A-Za-z])(?=[0-9])"]

    def parts(s: str) -> list[str]:
        s = re.sub(cuts[0], "\x01\\1", s)
        for c in cuts[1:]:
            s = re.sub(c, "\\1\x01", s)
        return [p for p in s.split("\x01") if p]

    simple("lex_tokens", lex, "array<string>", pa.list_(pa.string()))
    simple("normalize_line", tidy, "string", pa.string())
    simple("masked_line", shape, "string", pa.string())
    simple("subtokens", parts, "array<string>", pa.list_(pa.string()))


def batches_of_tokens(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[list[list[str]]]:
    """Token lists of each Arrow batch, for functions that scan tokens in order."""
    for b in batches:
        yield [lex(t) or [] for t in b.column(text).to_pylist()]
