"""Drafts of commit messages from diffs: type, scope, summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOC = r"(?i)(\.(md|markdown|rst|txt|adoc)$|(^|/)(docs?|license|readme|changelog)(/|\.|$))"
TEST = r"(?i)((^|/)(tests?|testdata|__tests__|spec)/|_test\.|\.test\.|\.spec\.|(^|/)test_)"
CI = r"(?i)((^|/)\.(github|circleci)/|(^|/)\.gitlab-ci|(^|/)jenkinsfile)"
BUILD = r"(?i)((^|/)(makefile|dockerfile|go\.(mod|sum)|package(-lock)?\.json|cargo\.(toml|lock)|pyproject\.toml|cmakelists\.txt)$|\.(gradle|bazel|mk)$)"


def diff_lines(diff: Column) -> Column:
    return F.split(F.coalesce(diff, F.lit("")), "\n")


def diff_paths(diff: Column) -> Column:
    """New paths of a unified diff."""
    return F.filter(F.regexp_extract_all(diff, F.lit(r"(?m)^\+\+\+ b/(\S+)"), F.lit(1)), lambda p: p != "")


def diff_counts(diff: Column) -> tuple[Column, Column, Column]:
    """(added, removed, makes a file)."""
    ls = diff_lines(diff)
    is_head = lambda x: F.startswith(x, F.lit("+++")) | F.startswith(x, F.lit("---"))
    added = F.size(F.filter(ls, lambda x: F.startswith(x, F.lit("+")) & ~is_head(x)))
    removed = F.size(F.filter(ls, lambda x: F.startswith(x, F.lit("-")) & ~is_head(x)))
    return added, removed, F.exists(ls, lambda x: F.startswith(x, F.lit("new file mode")))


def commit_type(files: Column, diff: Column) -> Column:
    """docs, test, ci or build if all files are of that kind; else by what the diff does."""
    fs = F.when(F.size(F.coalesce(files, F.array())) > 0, files).otherwise(diff_paths(F.coalesce(diff, F.lit(""))))
    every = lambda pattern: (F.size(fs) > 0) & F.forall(fs, lambda f: f.rlike(pattern))
    added, removed, new = diff_counts(diff)
    out = F.when(every(DOC), "docs").when(every(TEST), "test").when(every(CI), "ci").when(every(BUILD), "build").when(new, "feat")
    return out.when((added == 0) & (removed > 0), "refactor").when(F.size(fs) == 0, "chore").otherwise("fix")


def commit_scope(files: Column) -> Column:
    """The folder that all files share; below internal, cmd and pkg the name under it. Empty if none."""
    dirs = F.transform(F.coalesce(files, F.array()), lambda f: F.slice(F.split(f, "/"), 1, F.greatest(F.size(F.split(f, "/")) - 1, F.lit(0))))
    common = F.aggregate(F.slice(dirs, 2, F.greatest(F.size(dirs) - 1, F.lit(0))), F.get(dirs, F.lit(0)), lambda acc, d: _shared(acc, d))
    two = (F.size(common) >= 2) & F.get(common, F.lit(0)).isin("internal", "cmd", "pkg")
    return F.coalesce(F.when(two, F.get(common, F.lit(1))).otherwise(F.get(common, F.size(common) - 1)), F.lit(""))


def _shared(a: Column, b: Column) -> Column:
    n = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, same: F.struct((s["n"] + (s["on"] & same).cast("int")).alias("n"), (s["on"] & same).alias("on")))
    return F.slice(a, 1, n["n"])


def drafts(diffs: DataFrame, generated: DataFrame | None = None, most: int = 5) -> DataFrame:
    """(id, rank, message): up to four generated messages (id, seq, text) with a prefix where they lack one, and one made from the diff."""
    scope = commit_scope(F.col("files"))
    prefix = F.concat(commit_type(F.col("files"), F.col("diff")), F.when(scope != "", F.concat(F.lit("("), scope, F.lit(")"))).otherwise(""), F.lit(": "))
    base = diffs.select("id", "files", prefix.alias("prefix"))
    name = F.element_at(F.split(F.get("files", F.lit(0)), "/"), -1)
    what = F.when(F.size("files") == 1, F.concat(F.lit("update "), name)).when(F.size("files") > 1, F.concat(F.lit("update "), F.size("files").cast("string"), F.lit(" files"))).otherwise("update")
    out = base.select("id", F.lit(1_000_000).alias("seq"), F.concat("prefix", what).alias("message"))
    if generated is not None:
        first = F.trim(F.regexp_extract("text", r"^[^\n]*", 0))
        g = generated.select("id", "seq", first.alias("first")).where("first != ''").join(base.select("id", "prefix"), "id")
        ready = F.col("first").rlike(r"^[a-z]+(\([^)]*\))?!?: ")
        g = g.select("id", "seq", F.when(ready, F.col("first")).otherwise(F.concat("prefix", "first")).alias("message"))
        from quillframe.operators.lines import top

        g = top(g.groupBy("id", "message").agg(F.min("seq").alias("seq")), ["id"], [F.col("seq")], most - 1).select("id", "seq", "message")
        out = out.join(g.select("id", "message").distinct(), ["id", "message"], "left_anti").select("id", "seq", "message").unionByName(g)
    from pyspark.sql import Window

    return out.select("id", F.row_number().over(Window.partitionBy("id").orderBy("seq")).alias("rank"), "message")


MARK, MOST_BODY = "@@@COMMIT@@@", 64 << 10


def diff_body(diff: Column) -> Column:
    """Lines of a diff that tell what it does: ``file`` and the new path of each file, then its added and removed lines up to a binary part."""
    sections = F.slice(F.split(F.concat(F.lit("\n"), F.coalesce(diff, F.lit(""))), "\ndiff --git "), 2, 1 << 30)

    def lines(section: Column) -> Column:
        rows = F.split(section, "\n")
        path = F.regexp_extract(F.get(rows, F.lit(0)), r'(?:^| )"?b/(.*?)"?$', 1)
        binary = F.array_position(F.transform(rows, lambda x: F.startswith(x, F.lit("Binary files ")) | (x == "GIT binary patch")), F.lit(True)).cast("int")
        shown = F.filter(F.when(binary > 0, F.slice(rows, 1, F.greatest(binary - 1, F.lit(1)))).otherwise(rows), lambda x: x.rlike(r"^(?:\+(?!\+\+)|-(?!--))"))
        return F.concat(F.when(path != "", F.array(F.concat(F.lit("file "), path))).otherwise(F.expr("CAST(array() AS array<string>)")), shown)

    return F.flatten(F.transform(sections, lines))


def _bounded(text: Column) -> Column:
    """Whole lines of ``text`` up to the one with which it reaches MOST_BODY characters."""
    return F.when(F.length(text) <= MOST_BODY, text).otherwise(F.concat(F.substring(text, 1, MOST_BODY), F.regexp_extract(F.substring(text, MOST_BODY + 1, 1 << 30), r"^[^\n]*\n?", 0)))


def commit_documents(logs: DataFrame) -> DataFrame:
    """(repo, sha, text): a document for each commit of logs (repo, log) as ``git log -p`` prints them with ``MARK`` before hash and subject.

    Commits without a changed line or file, such as merges, are left out; null logs have none.
    """
    commits = logs.select("repo", F.explode(F.slice(F.split(F.regexp_replace("log", "\r", ""), MARK), 2, 1 << 30)).alias("c"))
    head = F.regexp_extract("c", r"^[^\n]*", 0)
    parts = commits.select("repo", F.regexp_extract(head, r"^(\S*)", 1).alias("sha"), F.regexp_extract(head, r"^\S* (.*)$", 1).alias("subject"), diff_body(F.regexp_replace("c", r"^[^\n]*\n?", "")).alias("body"))
    body = _bounded(F.concat(F.array_join("body", "\n"), F.lit("\n")))
    return parts.where((F.size("body") > 0) & (F.col("sha") != "")).select("repo", "sha", F.concat(F.lit("commit "), "sha", F.lit("\n"), body, F.lit("msg: "), "subject", F.lit("\n")).alias("text"))


def prompts(diffs: DataFrame) -> DataFrame:
    """(id, text): what a model is asked to go on from, for diffs (id, files, diff): the same form up to ``msg:``, with the files alone where the diff shows nothing."""
    body = diff_body(F.col("diff"))
    names = F.transform(F.coalesce("files", F.expr("CAST(array() AS array<string>)")), lambda f: F.concat(F.lit("file "), F.replace(f, F.lit("\\"), F.lit("/"))))
    lines = F.when(F.size(body) > 0, body).otherwise(names)
    joined = F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return diffs.select("id", F.concat(F.lit("commit staged\n"), _bounded(joined), F.lit("msg:")).alias("text"))
