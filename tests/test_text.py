import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillframe.functions import text as X
from quillframe.functions import vocabulary as V


def scan(src):
    """A plain scanner, one character at a time."""
    out, i, start = [], 0, True
    src = src.replace("\r", "\r")
    name = lambda c: c in "_$" or c.isascii() and c.isalpha() or ord(c) >= 0x80
    while i < len(src):
        c = src[i]
        if c == "\r":
            i += 1
        elif c == "\n":
            out.append(c)
            i, start = i + 1, True
        elif c in " \t":
            j = i
            while j < len(src) and src[j] in " \t":
                j += 1
            k = j
            while k < len(src) and src[k] == "\r":
                k += 1
            if not start:
                out.append(" ")
            elif k < len(src) and src[k] != "\n":
                out.append(src[i:j])
            i, start = j, False if not start or (k < len(src) and src[k] != "\n") else start
        else:
            start = False
            if src[i : i + 2] in ("//", "/*", "*/"):
                j = i + 2
            elif c == "#":
                j = i + 1
            elif c in "\"'`":
                j = i + 1
                while j < len(src) and src[j] != c and (c == "`" or src[j] != "\n"):
                    j += 2 if src[j] == "\\" else 1
                j = min(len(src), j)
                if j < len(src) and src[j] == c:
                    j += 1
            elif name(c):
                j = i + 1
                while j < len(src) and (name(src[j]) or src[j] in "0123456789"):
                    j += 1
            elif c in "0123456789":
                j = i + 1
                while j < len(src) and (name(src[j]) or src[j] in "0123456789."):
                    j += 1
            else:
                op = next((o for o in V.OPERATORS if src.startswith(o, i)), c)
                j = i + len(op)
            out.append(src[i:j])
            i = j
    return out + [X.END]


TEXTS = [
    "func f(a int) {\n\treturn a+1\n}\n", "x := `raw\nstring` // note\n", "  \n\n   a  b\t c  \n", "s = 'it\\'s' \"un\nterminated", "a<<=b...c**=d??e?.f", "naïve été_1 $x 0x1F 1.5e3", "", "#!/bin/sh\necho hi /* c */",
]


@pytest.mark.parametrize("src", TEXTS)
def test_lexer_equals_a_plain_scanner(src):
    assert X.lex(src) == scan(src)


def test_columns_equal_python(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, "a\r\n  \r\n b", '"' + "\\a" * 600 + '"'])]
    got = X.with_tokens(spark.createDataFrame(rows, "i int, text string")).collect()
    assert {r["i"]: r["toks"] for r in got} == {i: X.lex(t) for i, t in rows}


@given(st.text(alphabet="ab_$1 \t\n'\"`\\/*#.=é", max_size=40))
@settings(max_examples=300, deadline=None)
def test_tokens_joined_are_the_text_but_for_blanks(src):
    squeeze = lambda s: re.sub(r"[ \t]+", "", s)
    toks = X.lex(src)
    assert toks[-1] == X.END and squeeze("".join(toks[:-1])) == squeeze(src)


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_normalize_and_masks(spark):
    assert one(spark, X.normalize, "  a \t b  ", "\t", "a\r", None) == ["a b", "", "a", None]
    assert one(spark, X.masked_line, "if foo_1(bar) { return 'x' }", "x") == ["if \x02(\x02) { return 'x' }", "\x02"]


def test_subtokens_join_to_the_name(spark):
    names = ["parseHTTPHeader2x", "snake_case_9", "ABC", "a", "_x", "camelCase", "x-y"]
    got = one(spark, X.subtokens, *names)
    assert ["".join(p) for p in got] == names
    assert got[0] == ["parse", "HTTP", "Header", "2", "x"] and got[5] == ["camel", "Case"]
    assert one(spark, lambda c: X.name_key(X.subtokens(c)), "parseHeader", "snake_case") == ["parse|header", "snake|case"]


def test_languages(spark):
    assert one(spark, X.language_of, "a/b.GO", "file:///x/y.tsx?v=1#t", "Dockerfile", "x/GNUmakefile", "noext", "a.unknown", "a.md") == ["go", "typescript", "dockerfile", "makefile", "other", "other", "markdown"]
    md = lambda c: X.embedded_language(F.lit("markdown"), c)
    assert one(spark, md, "text\n```go\nx", "```py\na\n```\n", "``` nope\n") == ["go", "markdown", "markdown"]
    html = lambda c: X.embedded_language(F.lit("html"), c)
    assert one(spark, html, "<script>a", "<script lang=ts>a", "<script></script>", "<?php echo", "<?php ?>") == ["javascript", "typescript", "html", "php", "html"]


def test_acceptance(spark):
    assert one(spark, X.acceptable_text, "ok\n", "", None, "a\x00b", "// DO NOT EDIT\n", "x" * 501, "y" * 500) == [True, False, False, False, False, False, True]
    assert one(spark, X.skippable_name, "a/package-lock.json", "b/x.min.js", "c/x_generated.go", "d/main.go") == [True, True, True, False]
    assert one(spark, X.skippable_dir, "a/node_modules/x.js", "src/.git/config", "src/a.py", "./a.py") == [True, True, False, False]
    assert one(spark, lambda c: X.foreign_line(c, F.lit("python")), "x := 1", "if (n := f()) > 1:", "func f()", "def f():", "funcs = 1") == [True, False, True, False, False]
    assert one(spark, X.infix_tail, "f(w, ok, map[a]b{", "x = ab", "nothing") == ["map[a]b{", "", ""]
    assert one(spark, X.indent_unit, "a\n  b", "a\n\tb", "a") == ["  ", "\t", "    "]


def test_suggestions(spark):
    rows = [("foo()", "", "", True), ("f", "", "", False), ("foo()", "foo() bar", "", False), ("x)", "y", ")", False), ("foo(a)", "tail", "a)", True), ("a) b", "tail", "a)", False)]
    df = spark.createDataFrame(rows, "s string, tail string, rest string, ok boolean")
    got = df.select("ok", X.acceptable_suggestion(F.col("s"), F.col("tail"), F.col("rest")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["ok"] for r in got]


def test_sql_functions(spark):
    X.register(spark)
    assert spark.sql("SELECT normalize_line('  a   b ') AS n, masked_line('x = y') AS m, size(lex_tokens('a b')) AS k").head().asDict() == {"n": "a b", "m": "\x02 = \x02", "k": 4}


def test_foreign_words_are_sought_only_where_a_part_of_the_line_equals_one(spark):
    lines = ["xdef y", "def", "a def.b", "_def def_", "None\ndef", "x\nNone", "elifdef", "$None", "(None)", "", None]
    assert one(spark, lambda c: X.foreign_line(c, F.lit("go")), *lines) == [False, True, True, False, True, False, False, False, True, False, None]
    shown = str(X.foreign_line(F.col("id"), F.lit("go")))
    assert "(?:^|" in shown and "|(?:^|" not in shown  # one pattern for the words of a language, not one alternative with its own ends for each


def test_even_blanks_need_no_tidying(spark):
    texts = ["a b\nc d", "", " ", "a", " a", "a ", "a \n", "a \nb", "\n a", "a\n", "a\r\nb", "a\tb", "a  b", "\"x  y\" z", "a b\n\nc", "é b\n", "a \n ", "\n", "'a\n b'", "a \\  b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "i long, t string")

    def plain(t):
        lines, out = t.replace("\r", "").split("\n"), []
        raw = [m.group() for m in re.finditer(X._PYTHON_TOKEN, t) if m.group() != "\r"]
        for k, x in enumerate(raw):
            first, last = k == 0 or raw[k - 1] == "\n", k + 1 == len(raw) or raw[k + 1] == "\n"
            out += [] if x[0] in " \t" and first and last else [x if first or x[0] not in " \t" else " "]
        return out

    got = {r["i"]: r["k"] for r in df.select("i", X.tokens(F.col("t"), end=False).alias("k")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)} | {99: None}
    assert [X.lex(t, end=False) for t in texts] == [plain(t) for t in texts]


def test_a_text_is_lexed_once(spark):
    from quillframe.operators import lines, tables

    df = spark.createDataFrame([(1, "a b"), (2, "b")], "doc_id long, text string").repartition(2).withColumn("lang", F.lit("x"))
    lexed = X.with_tokens(df)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString().splitlines()
    for d in (tables.language_unigrams(lexed), tables.language_bigrams(lexed)):
        assert not any("regexp_extract_all(" in x for x in plan(d))  # counts that are read twice are written
    for d in (tables.structure_table(lexed), tables.token_counts(lexed)):
        assert any("regexp_extract_all(" in x for x in plan(d)) and not any("Filter" in x and "regexp_extract_all(" in x and "<eof>" in x for x in plan(d))
    for d in (lines.kept_lines(df), lines.line_index(df)):
        assert any("split(" in x for x in plan(d)) and not any("Filter" in x and "split(" in x for x in plan(d))


def test_first_token_of_a_line(spark):
    rows = [(t,) for t in ["foo bar", "\"a b\" c", "// x", "a", "  ", " :=x", "9a.b c"]]
    df = spark.createDataFrame(rows, "t string")
    assert all(r["a"] == r["b"] for r in df.select(X.first_line_token(F.col("t")).eqNullSafe(F.get(X.line_tokens(F.col("t")), F.lit(0))).alias("a"), F.lit(True).alias("b")).collect())
