"""Queries over small programs, since the tables hold no source code; their SQL is the expected result, written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import commits as C
from quillframe.operators import context as K
from quillframe.operators import edits as E
from quillframe.operators import facts as A
from quillframe.operators import goals as G
from quillframe.operators import symbols as S
from quillframe.plans.queries import query
from quillframe.shared import materialize

STORE = """package store

import "example/kv"

type Entry struct {
	Key string
	next *Entry
}

type Reader interface {
	Read(key string) Entry
}

type Store struct {
	db *kv.DB
	last Entry
}

var ErrMissing = errors.New("missing")

func (s *Store) Get(key string) *Entry {
	return nil
}

func (s *Store) Read(key string) Entry {
	return s.last
}

func open(path string, near *Entry) *Store {
	st := &Store{}
	return st
}
"""
MAIN = """package main

func run(all []Entry, one *Entry) {
	st := open("a.db", one)
	st.Get("k")
	st.Close()
	fmt.Println("done")
}
"""
BOX = """from app.models import User

class Box:
    size: int

    def fill(self, user: User) -> None:
        self.user = user

def load(path: str) -> Box:
    box = Box()
    box.fill(None)
    return box
"""


def _docs(spark):
    return spark.createDataFrame([("box.py", BOX), ("main.go", MAIN), ("store.go", STORE)], "doc_id string, text string")


def _facts(spark):
    return materialize(A.extract(_docs(spark)), "facts")  # read by many joins


def values(columns: str, rows: list[tuple]) -> str:
    """SQL that lists ``rows`` as they stand."""
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = [c.split()[1] for c in columns.split(", ")]
    text = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(f"{text(v)}::{k}" for v, k in zip(r, kinds)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) t({', '.join(names)})"


_FACTS = [
    ("box.py", "import", "", "", "User"), ("box.py", "import", "", "", "models"), ("box.py", "member", "Box", "", "fill("), ("box.py", "member", "Box", "", "size"), ("box.py", "member", "Box", "", "user"),
    ("box.py", "ret", "load", "", "Box"), ("box.py", "sig", "fill", "", "User"), ("box.py", "sig", "load", "", ""), ("box.py", "use", "app", "", "models"), ("box.py", "use", "box", "", "fill("),
    ("box.py", "var", "box", "", "Box"), ("box.py", "var", "user", "", "User"),
    ("main.go", "call_of", "st", "", "open"), ("main.go", "sig", "run", "", "[]Entry,*Entry"), ("main.go", "use", "fmt", "", "Println("), ("main.go", "use", "st", "", "Close("), ("main.go", "use", "st", "", "Get("),
    ("main.go", "var", "all", "[]", "Entry"), ("main.go", "var", "one", "*", "Entry"),
    ("store.go", "call_of", "ErrMissing", "", "New"), ("store.go", "field", "Entry", "next", "*Entry"), ("store.go", "field", "Store", "db", "*DB"), ("store.go", "field", "Store", "last", "Entry"), ("store.go", "iface", "Reader", "", "interface"),
    ("store.go", "import", "", "", "kv"), ("store.go", "member", "Entry", "", "Key"), ("store.go", "member", "Entry", "", "next"), ("store.go", "member", "Reader", "", "Read("), ("store.go", "member", "Store", "", "Get("),
    ("store.go", "member", "Store", "", "Read("), ("store.go", "member", "Store", "", "db"), ("store.go", "member", "Store", "", "last"), ("store.go", "ret", "Get", "", "Entry"), ("store.go", "ret", "Read", "", "Entry"),
    ("store.go", "ret", "open", "", "Store"), ("store.go", "sig", "Get", "", ""), ("store.go", "sig", "Read", "", ""), ("store.go", "sig", "open", "", ",*Entry"), ("store.go", "use", "errors", "", "New("), ("store.go", "use", "kv", "", "DB"),
    ("store.go", "use", "s", "", "last"), ("store.go", "var", "near", "*", "Entry"), ("store.go", "var", "s", "*", "Store"), ("store.go", "var", "st", "*", "Store"),
]


@query(values("doc VARCHAR, kind VARCHAR, k1 VARCHAR, k2 VARCHAR, v VARCHAR", _FACTS))
def fixture_facts(spark, sf_dir):
    """Facts of three small programs."""
    return A.extract(_docs(spark))


@query(values("path VARCHAR, kind VARCHAR, name VARCHAR, line INT", [
    ("box.py", "type", "Box", 3), ("box.py", "func", "fill", 6), ("box.py", "func", "load", 9), ("main.go", "func", "run", 3), ("store.go", "type", "Entry", 5), ("store.go", "type", "Reader", 10), ("store.go", "type", "Store", 14),
    ("store.go", "var", "ErrMissing", 19), ("store.go", "method", "Get", 21), ("store.go", "method", "Read", 25), ("store.go", "func", "open", 29),
]))
def fixture_symbols(spark, sf_dir):
    """Definitions in three small programs."""
    return S.extract(_docs(spark), F.col("doc_id")).select("path", "kind", "name", "line")


@query(values("func VARCHAR, member VARCHAR, cnt BIGINT, rnk INT", [
    ("open", "Get(", 3, 1), ("open", "Read(", 2, 2), ("open", "db", 2, 3), ("open", "last", 2, 4), ("Get", "Key", 2, 1), ("Get", "next", 2, 2), ("Read", "Key", 2, 1), ("Read", "next", 2, 2), ("load", "fill(", 2, 1), ("load", "size", 2, 2), ("load", "user", 2, 3),
]))
def fixture_call_members(spark, sf_dir):
    """What is used of functions' results in three small programs."""
    return A.call_members(_facts(spark))


_CURSORS = [
    (1, "main.go", "\tvar x *Entry =", ""), (2, "main.go", "\tone =", ""), (3, "main.go", "\tx := Store{last:", ""), (4, "main.go", "\tst = open(p,", ""), (5, "main.go", "\tall = append(all,", 'a("k")\nb("done")\n'),
    (6, "store.go", "\treturn", "func (s *Store) Read(key string) Entry {\n"), (7, "store.go", "\tif errors.Is(err,", "ErrMissing NotFoundError is\n"), (8, "main.go", "\tfoo", ""), (9, None, None, None), (10, "main.go", "\tall =", ""), (11, "main.go", "\trun(", ""),
]


def _cursors(spark):
    return spark.createDataFrame(_CURSORS, "query_id long, doc string, prefix string, before string")


_GOALS = [(1, "Entry", "*", "x"), (2, "Entry", "*", "one"), (3, "Entry", "", None), (4, "Entry", "*", None), (6, "Entry", "", None), (10, "Entry", "[]", "all"), (11, "Entry", "[]", None)]


@query(values("query_id BIGINT, type VARCHAR, shape VARCHAR, target VARCHAR", _GOALS))
def fixture_goals(spark, sf_dir):
    """The types that cursors in small programs demand."""
    return G.goals(_cursors(spark), _facts(spark)).select("query_id", "type", "shape", "target")


@query(values("query_id BIGINT, text VARCHAR, rnk INT", [(5, " *one)", 1), (5, ' "done")', 2), (5, ' "k")', 3), (7, " ErrMissing)", 1), (7, " NotFoundError)", 2)]))
def fixture_arguments(spark, sf_dir):
    """Arguments at cursors in small programs."""
    return G.arguments(_cursors(spark), _facts(spark)).select("query_id", "text", "rnk")


@query(values("query_id BIGINT, text VARCHAR, rnk INT", [
    (1, "one", 1), (1, "one.next", 2), (1, "Get()", 3), (1, "Read()", 4), (1, "nil", 5), (1, "&Entry{}", 6), (6, "*near", 1), (6, "s.last", 2), (6, "st.last", 3), (6, "Get()", 4), (6, "Read()", 5), (6, "Entry{}", 6),
]))
def fixture_synthesis(spark, sf_dir):
    """Expressions of the demanded type for two cursors."""
    facts = _facts(spark)
    goals = materialize(G.goals(_cursors(spark).where("query_id IN (1, 6)"), facts), "goals")
    return A.synthesize(goals, facts).select("query_id", "text", "rnk")


_LOG = (
    "@@@COMMIT@@@aaa first change\n\ndiff --git a/x.go b/x.go\nindex 1..2\n--- a/x.go\n+++ b/x.go\n@@ -1 +1 @@\n-old\n+new\n same\n"
    "@@@COMMIT@@@bbb a merge\n\n@@@COMMIT@@@ccc picture\n\ndiff --git a/p.png b/p.png\nBinary files a/p.png and b/p.png differ\n+no\ndiff --git a/y b/z y\n+++ b/z y\n+more\n"
)


@query(values("sha VARCHAR, text VARCHAR", [("aaa", "commit aaa\nfile x.go\n-old\n+new\nmsg: first change\n"), ("ccc", "commit ccc\nfile p.png\nfile z y\n+more\nmsg: picture\n")]))
def fixture_commit_documents(spark, sf_dir):
    """Documents of the commits of a log."""
    return C.commit_documents(spark.createDataFrame([("r", _LOG), ("n", None)], "repo string, log string")).select("sha", "text")


_DIFFS = [
    (1, ["docs/a.md", "README.md"], "+++ b/docs/a.md\n+x\n"), (2, ["internal/kv/db.go"], "diff --git a/internal/kv/db.go b/internal/kv/db.go\nnew file mode 100644\n+++ b/internal/kv/db.go\n+x\n"), (3, ["pkg/a/x.go", "pkg/a/y.go"], "-x\n-y\n"), (4, [], ""),
    (5, ["tests/test_x.py"], "+x\n-y\n"), (6, ["lib/x.py"], "+x\n-y\n"),
]


@query(values("id INT, rank INT, message VARCHAR", [
    (1, 1, "docs: update 2 files"), (2, 1, "feat(kv): update db.go"), (3, 1, "refactor(a): update 2 files"), (4, 1, "chore: update"), (5, 1, "test(tests): update test_x.py"), (6, 1, "fix(lib): update x.py"),
]))
def fixture_commit_drafts(spark, sf_dir):
    """Messages for six diffs."""
    return C.drafts(spark.createDataFrame(_DIFFS, "id int, files array<string>, diff string"))


@query(values("id INT, text VARCHAR", [
    (1, "commit staged\nfile docs/a.md\nfile README.md\nmsg:"), (2, "commit staged\nfile internal/kv/db.go\n+x\nmsg:"), (3, "commit staged\nfile pkg/a/x.go\nfile pkg/a/y.go\nmsg:"), (4, "commit staged\nmsg:"), (5, "commit staged\nfile tests/test_x.py\nmsg:"), (6, "commit staged\nfile lib/x.py\nmsg:"),
]))
def fixture_commit_prompts(spark, sf_dir):
    """What a model goes on from for six diffs."""
    return C.prompts(spark.createDataFrame(_DIFFS, "id int, files array<string>, diff string"))


@query(values("uri VARCHAR, version INT, old_side VARCHAR, new_side VARCHAR", [("a", 2, "count", "total"), ("a", 3, "", ", err"), ("b", 2, "x", "")]))
def fixture_edit_rules(spark, sf_dir):
    """Token rules between versions of two documents."""
    rows = [("a", 1, "count := f(a)\nkeep(a)"), ("a", 2, "total := f(a)\nkeep(a)"), ("a", 3, "total, err := f(a)\nkeep(a)"), ("b", 1, "f(x)"), ("b", 2, "f()"), ("b", 3, "f()")]
    return E.edit_rules(E.version_pairs(spark.createDataFrame(rows, "uri string, version int, text string"), "uri", "version", "text"), "uri", "version")


@query(values("query_id BIGINT, kind VARCHAR, name VARCHAR, value VARCHAR, rnk INT", [
    (1, "name", "Printing", "Printing", 1), (1, "name", "Entry", "Entry", 2), (1, "name", "open", "open", 3), (1, "def", "Entry", "store.go:5", 1), (1, "def", "open", "store.go:29", 2), (1, "usage", "open", ' ("a")', 1),
]))
def fixture_context(spark, sf_dir):
    """Names, definitions and usages around a cursor."""
    q = spark.createDataFrame([(1, "old(Nothing)\n" + "\n" * 40 + "e := Entry{}\nopen(Printing, Entry) return")], "query_id long, text string")
    index = spark.createDataFrame([('open ("a")', 2), ("closed", 1)], "line string, cnt long")
    return K.around(q, index, S.extract(_docs(spark), F.col("doc_id")))
