"""Tokens, indentation, methods, maps and masks against plain restatements."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thicket.functions import spans as SP
from thicket.functions import tokenizers as TK
from thicket.operators import lexemes as L
from thicket.operators import masks as MK
from thicket.operators import methods as J
from thicket.operators import metrics as M
from thicket.operators import properties as R
from thicket.operators import tree as T
from thicket.plans import QUERIES
from thicket.session import grouped
from thicket.sources import contexts as CF
from thicket.streaming import counts as C

LEXEMES = "sample_id bigint, idx bigint, text string, kind string, start struct<line: int, col: int>, end struct<line: int, col: int>"


def codes(seed, n=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        lines, depth = [], 0
        for _ in range(rng.randrange(0, 12)):
            depth = max(0, depth + rng.choice([-1, 0, 1, 1]))
            body = rng.choice(["x = 1", 'say "a" "b" now', '"only"', "", "if y:", "é = 42 # (c)", 'end "s"', "  odd"])
            lines.append(" " * (rng.choice([2, 4]) * depth) + body + rng.choice(["", "", "  "]))
        out.append("\n".join(lines) + rng.choice(["", "\n", "\n\n"]))
    return [*out, "", "\n", "x", " x\n  y", '"a"\n"b"', "a\n\tb\n\t\tc", None]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "sample_id bigint, code string")


def pieces(code):
    """(text, (line, col), (line, col)) of every token, found by cutting the text."""
    out, at = [], 0
    for m in re.finditer("|".join(f"(?:{p})" for _, p in L.RULES), code or ""):
        assert m.start() == at
        place = lambda k: (code.count("\n", 0, k) + 1, k - (code.rfind("\n", 0, k) + 1) + 1)
        out.append((m[0], place(m.start()), place(m.end())))
        at = m.end()
    assert at == len(code or "")
    return out


def shown(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.sample_id, r.idx)):
        out.setdefault(r.sample_id, []).append((r.text, tuple(r.start), tuple(r.end)))
    return out


def test_rules_and_spans(spark):
    texts = codes(1)
    got = shown(L.by_rules(frame(spark, texts)).collect())
    assert got == {k: p for k, t in enumerate(texts) if (p := pieces(t))}


def strings_masked(tokens):
    """Runs by looking at each token's neighbours."""
    is_string = [t.startswith('"') and len(t) > 1 for t, _, _ in tokens]
    out = []
    for k, t in enumerate(tokens):
        if not is_string[k]:
            out.append(t)
        elif k == 0 or not is_string[k - 1]:
            end = next((j for j in range(k, len(tokens)) if not is_string[j]), None)
            if end is not None:
                out.append(("[MASK_STRING]", t[1], tokens[end - 1][2]))
    return out


def test_string_runs(spark):
    texts = codes(2)
    got = shown(L.mask_strings(L.by_rules(frame(spark, texts))).collect())
    assert got == {k: p for k, t in enumerate(texts) if (p := strings_masked(pieces(t)))}


def style(code):
    depths = [len(x) - len(x.lstrip()) for x in (code or "").splitlines() if x == "" or x.strip()]
    changes = Counter(abs(a - b) for a, b in zip(depths, depths[1:], strict=False))
    changes.pop(0, None)
    return min((s for s in changes if changes[s] == max(changes.values())), default=None)


def test_indentation_style(spark):
    texts = codes(3)
    got = {r.sample_id: r.style for r in L.indent_styles(frame(spark, texts)).collect()}
    assert got == {k: s for k, t in enumerate(texts) if (s := style(t))}


def marks(code):
    """Marks before the first token of each line, from the depth of every line alone: lines at whole steps set the level."""
    s = style(code)
    tokens = pieces(code)
    lines = [[]]
    for t in tokens:
        if "\n" in t[0] and not t[0].strip():
            lines.append([t])
        else:
            lines[-1].append(t)
    out, level, first = [], 0, True
    for n, line in enumerate(lines):
        if n:
            out.append("\n")
        space = 0
        opened = False
        for text, (row, _), _ in line[1:] if n else line:
            if not text.strip():
                space += 0 if opened else len(text)
                continue
            if not opened:
                opened = True
                depth = space + (len(line[0][0]) - 1 if n else 0)
                if depth % s == 0:
                    steps = (depth - level) // s
                    if first and row > 1:
                        steps, first = 1, False
                    out += [("[INDENT]" if steps > 0 else "[DEDENT]")] * abs(steps)
                    level = depth
            out.append(text)
    return out


def test_marks_of_indentation(spark):
    texts = codes(4, 80)
    df = frame(spark, texts)
    got = shown(L.indented(L.by_rules(df), L.indent_styles(df)).collect())
    want = {k: marks(t) for k, t in enumerate(texts) if style(t)}
    assert {k: [x for x, _, _ in v] for k, v in got.items()} == want
    flat = shown(L.indented(L.by_rules(df), L.indent_styles(df), allow_flat=True).collect())
    assert {k: [x for x, _, _ in v] for k, v in flat.items() if k in got} == want and set(flat) - set(got)
    unfixed = shown(L.indented(L.by_rules(df), L.indent_styles(df), fix_first=False).collect())
    assert unfixed != got


def test_mark_spans(spark):
    df = frame(spark, ["a\n  b\n      c\nd"])
    got = shown(L.indented(L.by_rules(df), L.indent_styles(df)).collect())[0]
    assert [t for t in got if t[0][0] == "["] == [("[INDENT]", (2, 1), (2, 3)), ("[INDENT]", (3, 1), (3, 3)), ("[INDENT]", (3, 3), (3, 5)), ("[DEDENT]", (4, 1), (4, 1)), ("[DEDENT]", (4, 1), (4, 1)), ("[DEDENT]", (4, 1), (4, 1))]


def descent(token, nodes):
    """From the root, by recursion over children in order."""
    at = next(n for n, p, *_ in nodes if p is None)
    while True:
        fits = [(hi - lo, n) for n, p, lo, hi in nodes if p == at and lo <= token[0] and hi >= token[1]]
        if not fits:
            return at
        at = min(fits, key=lambda x: x[0])[1]


def test_greedy_descent(spark):
    rng = random.Random(6)
    nodes, tokens, want = [], [], {}
    for s in range(12):
        mine = [(0, None, 0, 100)]
        for n in range(1, rng.randrange(2, 30)):
            p = rng.randrange(n)
            lo = rng.randrange(-2, 95)
            mine.append((n, p, lo, lo + rng.randrange(0, 60)))
        nodes += [(s, *x) for x in mine]
        for t in range(25):
            a = rng.randrange(-3, 110)
            b = a + rng.randrange(0, 12)
            tokens.append((s, t, a, b))
            want[s, t] = descent((a, b), mine)
    n = spark.createDataFrame(nodes, "sample_id bigint, node_id int, parent_id int, lo int, hi int")
    t = spark.createDataFrame(tokens, "sample_id bigint, token_idx int, start int, stop int")
    assert {(r.sample_id, r.token_idx): r.node_id for r in T.tightest_node(t, n).collect()} == want


def test_descent_goes_into_smaller_overlapping_siblings(spark):
    """The smallest node of all may be in a sibling that the descent leaves aside."""
    n = spark.createDataFrame([(1, 0, None, 0, 50), (1, 1, 0, 0, 20), (1, 2, 0, 5, 15), (1, 3, 1, 6, 8)], "sample_id bigint, node_id int, parent_id int, lo int, hi int")
    t = spark.createDataFrame([(1, 0, 6, 7), (1, 1, 49, 51)], "sample_id bigint, token_idx int, start int, stop int")
    assert {r.token_idx: r.node_id for r in T.tightest_node(t, n).collect()} == {0: 2, 1: 0}


def test_deep_trees_are_whole_or_refused(spark):
    chain = spark.createDataFrame([(1, k, k - 1 if k else None) for k in range(40)], "sample_id bigint, node_id int, parent_id int")
    assert T.closure(chain).agg(F.max("height")).first()[0] == 39
    with pytest.raises(Exception, match="max_depth"):
        T.closure(chain, 16).collect()


JAVA = '''package p;
import a.b.*;
/** About { A. */
public class A<T> extends B {
  private static final int[] X = {1, 2, 3};
  static { init(); }
  /**
   * Makes one.
   * @param x an int
   */
  public A(int x) { this.x = x; }
  @Note({"a", "b"}) public List<Map<String, T>> get(int a, String... b) throws IOException, java.lang.Foo {
    // brace } in comment
    String s = "}{\\"" + '}' + '\\'';
    if (a > 0) { call("x"); } else { g(); }
    for (int i = 0; i < a; i++) { run(new Task() { @Override public void run() { h(); } }); }
    Supplier<T> q = () -> { return null; };
    try (X x = open()) { } catch (E e) { }
    switch (a) { case 1: break; }
    return null;
  }
  int[] arr(int[] q) { return new int[] {1, 2}; }
  abstract void none();
  enum E { P(1) { int f() { return 1; } }, Q(2); E(int k) { } }
  interface I { default void dm() { /* } */ } void nope(); }
  void get() {
  }
  record R(int a) { int twice() { return 2 * a; } }
}
void bare(int a) { x(); }
'''


def test_methods(spark):
    rows = [(1, JAVA), (2, None), (3, ""), (4, "class Z { Z() { } void broken( { void lost() {"), (5, JAVA)]
    df = spark.createDataFrame(rows, "sample_id bigint, code string")
    got = J.methods(df, constructors=True).orderBy("sample_id", "first_line", "code").collect()
    one = [(r.name, r.kind, r.class_name, r.first_line, r.last_line) for r in got if r.sample_id == 1]
    assert sorted(one, key=lambda x: (x[3], x[0])) == [
        ("A", "constructor", "A", 11, 11), ("get", "method", "A", 12, 21), ("run", "method", None, 16, 16), ("arr", "method", "A", 22, 22), ("E", "constructor", "E", 24, 24), ("f", "method", None, 24, 24),
        ("dm", "method", "I", 25, 25), ("get", "method", "A", 26, 27), ("twice", "method", "R", 28, 28), ("bare", "method", None, 30, 30),
    ]
    assert [r for r in got if r.sample_id == 5] and {r.name for r in got if r.sample_id == 4} == {"Z"}
    by = {(r.name, r.first_line): r for r in got if r.sample_id == 1}
    assert by["A", 11].doc == "Makes one.\n@param x an int" and by["A", 11].code == "public A(int x) { this.x = x; }"
    assert by["get", 12].n_lines == 7 and by["get", 26].n_lines == 0 and by["run", 16].code == "@Override public void run() { h(); }"
    assert all(r.body[0] == "{" and r.body[-1] == "}" and r.code.endswith(r.body) for r in got)
    assert {r.name for r in J.methods(df, 2).collect()} == {"get"}
    assert {r.name for r in J.methods(df, 1, 1).where("sample_id = 1").collect()} == {"run", "arr", "f", "twice", "bare"}


def test_methods_of_a_folder(spark, tmp_path):
    from thicket.sources.files import read_code_files

    (tmp_path / "p" / "deep").mkdir(parents=True)
    (tmp_path / "p" / "A.java").write_text(JAVA)
    (tmp_path / "p" / "deep" / "B.java").write_bytes("class B { String n() { return \"caf\xe9\"; } }".encode("cp1252"))
    (tmp_path / "p" / "C.txt").write_text(JAVA)
    files = read_code_files(spark, f"file://{tmp_path}").select(F.col("path").alias("sample_id"), F.col("content").alias("code"))
    got = {(r.sample_id.rsplit("/", 1)[1], r.name) for r in J.methods(files).collect()}
    assert ("B.java", "n") in got and ("A.java", "bare") in got and not any(f == "C.txt" for f, _ in got)


def bleu_of(rows, most=4):
    match, total, c, r = Counter(), Counter(), 0, 0
    for refs, cand in rows:
        cand = cand or []
        c += len(cand)
        r += min(((abs(len(x) - len(cand)), len(x)) for x in refs), default=(0, 0))[1]
        for n in range(1, most + 1):
            grams = lambda w, n=n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
            best = Counter()
            for x in refs:
                best |= grams(x)
            match[n] += sum((grams(cand) & best).values())
            total[n] += sum(grams(cand).values())
    p = [match[n] / total[n] if total[n] else 0 for n in range(1, most + 1)]
    bp = 0 if c == 0 else 1 if c >= r else math.exp(1 - r / c)
    return p, bp, bp * math.exp(sum(map(math.log, p)) / most) if all(p) else 0


@pytest.mark.parametrize("seed", range(3))
def test_bleu(spark, seed):
    rng = random.Random(seed)
    words = lambda n: [rng.choice("abcd") for _ in range(n)]
    rows = [(k, [words(rng.randrange(0, 15)) for _ in range(rng.randrange(1, 4))], words(rng.randrange(0, 15))) for k in range(20)] + [(100, [words(5)], []), (101, [words(4)], None), (102, [[]], words(3))]
    got = M.bleu(spark.createDataFrame(rows, "id bigint, references array<array<string>>, candidate array<string>"), "id").orderBy("order").collect()
    p, bp, score = bleu_of([x[1:] for x in rows])
    assert [r.precision for r in got] == pytest.approx(p) and got[0].brevity_penalty == pytest.approx(bp) and got[0].bleu == pytest.approx(score)


def test_bleu_without_matches(spark):
    schema = "id bigint, references array<array<string>>, candidate array<string>"
    got = M.bleu(spark.createDataFrame([(1, [["a"]], ["b", "c"])], schema), "id").collect()
    assert len(got) == 4 and {r.bleu for r in got} == {0.0}
    assert {(r.matches, r.bleu) for r in M.bleu(spark.createDataFrame([], schema), "id").collect()} == {(0, 0.0)}


def test_counters_survive_a_crash(spark, tmp_path):
    """Three batches; the stream dies after the second one is written and before it is noted, and is started anew."""
    texts = ["a b a", "b c", "a c c d"]
    for k, t in enumerate(texts):
        spark.createDataFrame([(t,)], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = lambda: spark.readStream.schema("text string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    out = f"{tmp_path}/out"

    def dies(number):
        if number == 1:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        C.durable(C.word_counts(files()), out, after=dies).awaitTermination()
    C.durable(C.word_counts(files()), out).awaitTermination()
    want = Counter(w for t in texts for w in t.split())
    assert {r.word: r.cnt for r in C.latest(spark, out, "word").collect()} == want
    spark.createDataFrame([("d e",)], "text string").coalesce(1).write.parquet(f"{tmp_path}/in/9")
    C.durable(C.word_counts(files()), out).awaitTermination()
    assert {r.word: r.cnt for r in C.latest(spark, out, "word").collect()} == want + Counter("de")


def test_context_files(spark, tmp_path):
    lines = [("python", "get|x a,P,b c,P|Q,d"), ("python", "t a,P,b c,P,d e,P,f g,P,h i,P,j k,P,l"), ("go", "lonely"), ("go", "")]
    path = f"file://{tmp_path}/c"
    CF.write_path_contexts(spark.createDataFrame(lines, "language string, value string"), path, 5)
    got = {(r.language, r.target): (r.contexts, r.n_valid) for r in CF.read_path_contexts(spark, path, 4, 5).collect()}
    assert got == {("python", "get|x"): (["a,P,b", "c,P|Q,d", "", ""], 2), ("python", "t"): (["a,P,b", "c,P,d", "e,P,f", "g,P,h"], 4), ("go", "lonely"): ([""] * 4, 0), ("go", ""): ([""] * 4, 0)}
    draw = lambda seed: {r.target: r.contexts for r in CF.read_path_contexts(spark, path, 4, 5, seed).collect()}
    one, two = draw(1), draw(2)
    assert one == draw(1) and one != two
    assert sorted(one["get|x"]) == ["", "", "a,P,b", "c,P|Q,d"] and len(set(one["t"])) == 4 and set(one["t"]) <= {"a,P,b", "c,P,d", "e,P,f", "g,P,h", "i,P,j"}
    parts = spark.createDataFrame([(["a|b,P|Q,c", ""],)], "c array<string>").select(CF.parts_of(F.col("c")).alias("p")).first().p
    assert [tuple(x) for x in parts] == [(["a", "b"], ["P", "Q"], ["c"]), ([], [], [])]
    plan = CF.read_path_contexts(spark, path, 4, 5).select("language")._jdf.queryExecution().executedPlan().toString()
    assert "regexp_replace" in plan and "transform" not in plan  # what isn't asked for isn't made


def test_tokenizer_plug_ins(spark):
    @TK.tokenizer("letters of the test")
    def letters(text):
        for n, line in enumerate(text.split("\n"), 1):
            for k, c in enumerate(line):
                if c.isalpha():
                    yield c, "Token.Letter", (n, k + 1), (n, k + 2)

    @TK.tokenizer("pairs of the test")
    def pairs(text):
        if "!" in text:
            raise ValueError("no exclamations")
        return [(text[k : k + 2], "Token.Pair", (1, k + 1), (1, k + 1 + len(text[k : k + 2]))) for k in range(0, len(text), 2)]

    texts = ["ab c\nd", "", None, "x!", "é1"]
    df = frame(spark, texts)
    got = shown(TK.tokenized(df, "letters of the test").collect())
    assert got == {k: [(c, (1 + t.count("\n", 0, i), i - t.rfind("\n", 0, i)), (1 + t.count("\n", 0, i), i - t.rfind("\n", 0, i) + 1)) for i, c in enumerate(t) if c.isalpha()] for k, t in enumerate(texts) if t}
    two = TK.tokenized(df, "pairs of the test").collect()
    assert {(r.sample_id, r.text) for r in two if r.kind == "Token.Pair"} == {(0, "ab"), (0, " c"), (0, "\nd"), (4, "é1")}
    assert [(r.sample_id, r.text) for r in two if r.kind == "Token.Error"] == [(3, "no exclamations")]
    with pytest.raises(ValueError, match="named"):
        TK.tokenizer("words")(pairs)
    code = TK.tokenized(frame(spark, ["def f(x):\n    return x\n"]), "python").collect()
    lines = ["def f(x):", "    return x"]
    for r in code:
        if r.kind == "Token.Python.NAME":
            assert lines[r.start.line - 1][r.start.col - 1 : r.end.col - 1] == r.text
    assert TK.from_semantic({"symbol": "f", "kind": "Fn", "span": {"start": {"line": 1, "column": 2}, "end": {"line": 1, "column": 3}}}) == ("f", "Fn", (1, 2), (1, 3))


def test_span_deltas(spark):
    rng = random.Random(2)
    rows = []
    for s in range(5):
        line = 1
        for k in range(40):
            line = max(1, line + rng.choice([-3, 0, 0, 1, 5]))
            a, n = rng.randrange(1, 300), rng.choice([0, 0, 0, 2])
            rows.append((s, k, ((line, a), (line + n, rng.randrange(1, 80) if n else a + rng.randrange(0, 9)))))
    schema = "sample_id bigint, k int, span struct<start: struct<line: int, col: int>, end: struct<line: int, col: int>>"
    df = spark.createDataFrame(rows, schema)
    small = SP.deltas(df, "sample_id", "k")
    assert sorted(map(str, SP.restored(small, "sample_id", "k").select(*df.columns).collect())) == sorted(map(str, df.collect()))
    sizes = SP.packed_size(small, "sample_id").collect()
    assert all(r.n == 40 and r.plain_bytes == 640 and r.packed_bytes < 240 for r in sizes)
    values = [0, 1, -1, 63, 64, -64, -65, 8191, 8192, -(1 << 30)]
    got = spark.createDataFrame([(v,) for v in values], "v bigint").select(SP.size(F.col("v")).alias("n")).collect()
    assert [r.n for r in got] == [max(1, -(-((2 * v) if v >= 0 else -2 * v - 1).bit_length() // 7)) for v in values]
    moved = df.limit(1).select(SP.unwrapped(F.col("span")).alias("u"), "span").first()
    assert (moved.u.start.line, moved.u.start.col, moved.u.end.line, moved.u.end.col) == (moved.span.start.line - 1, moved.span.start.col, moved.span.end.line - 1, moved.span.end.col + 1)


def test_masks_equal_a_rebuild(spark):
    rng = random.Random(3)
    words = [[rng.choice(["get", "(", ")", "x1", "[INDENT]", "42", "_"]) for _ in range(rng.randrange(0, 12))] for _ in range(10)]
    tokens = [(s, k, w) for s, t in enumerate(words) for k, w in enumerate(t)]
    cells = {(s, i, j): i * 100 + j for s, t in enumerate(words) for i in range(len(t)) for j in range(len(t)) if rng.random() < 0.6}
    t = spark.createDataFrame(tokens, "sample_id bigint, token_idx int, text string").withColumn("keep", MK.is_word(F.col("text")))
    m = t.select("sample_id", "token_idx", (F.col("token_idx") * 7).alias("node_id"))
    x = spark.createDataFrame([(s, i, j, v) for (s, i, j), v in cells.items()], "sample_id bigint, i int, j int, value int")
    kept, nodes, matrix = MK.masked(t, m, "keep", x)
    good = {s: [k for k, w in enumerate(t) if re.search("[A-Za-z]", w) and w != "[INDENT]"] for s, t in enumerate(words)}
    assert {(r.sample_id, r.token_idx, r.text) for r in kept.collect()} == {(s, n, words[s][k]) for s, ks in good.items() for n, k in enumerate(ks)}
    assert {(r.sample_id, r.token_idx, r.node_id) for r in nodes.collect()} == {(s, n, 7 * k) for s, ks in good.items() for n, k in enumerate(ks)}
    assert {(r.sample_id, r.i, r.j): r.value for r in matrix.collect()} == {(s, a, b): cells[s, i, j] for s, ks in good.items() for a, i in enumerate(ks) for b, j in enumerate(ks) if (s, i, j) in cells}
    same, _, _ = MK.masked(t, m, "keep", renumber=False)
    assert {(r.sample_id, r.token_idx) for r in same.collect()} == {(s, k) for s, ks in good.items() for k in ks}
    row = spark.createDataFrame([([True, None, False, True], [1, 2, 3, 4], ["a", "b", "c", "d"])], "k array<boolean>, a array<int>, b array<string>").select(MK.compressed(F.col("k"), F.col("a"), F.col("b")).alias("c")).first().c
    assert (row.a0, row.a1) == ([1, 4], ["a", "d"])


def test_node_properties(spark):
    schema = "node_type string, operator string, text string, own_name string, generic boolean, is_leaf boolean, parent_type string"
    rows = [
        ("BinaryExpr", "plus", "a + b", None, False, False, "ReturnStmt"), ("ClassOrInterfaceType", None, "Integer", "Integer", False, True, None), ("ClassOrInterfaceType", None, "List<T>", "List", True, True, None),
        ("ClassOrInterfaceType", None, "List<T>", "List", True, False, None), ("IntegerLiteralExpr", None, "32", None, False, True, None), ("IntegerLiteralExpr", None, "77", None, False, True, None),
        ("NameExpr", None, "getName", None, False, True, "MethodDeclaration"), ("NameExpr", None, "getHTTPName2", None, False, True, "BlockStmt"), ("StringLiteralExpr", None, '""', None, False, True, None),
        ("UnaryExpr", None, "1", None, None, None, None), ("Unknown", None, None, None, None, None, None),
    ]
    got = [(r.path_type, r.short_type, r.name) for r in R.with_properties(spark.createDataFrame(rows, schema)).collect()]
    assert got == [
        ("BinaryExpr:plus", "Plus", "a|+|b"), ("PrimitiveType", "Prim", "integer"), ("GenericClass", "GenericClass", "list"), ("ClassOrInterfaceType", "Cls", "list"), ("IntegerLiteralExpr", "IntEx", "32"),
        ("IntegerLiteralExpr", "IntEx", "<NUM>"), ("NameExpr", "Nm", "METHOD_NAME"), ("NameExpr", "Nm", "get|http|name"), ("StringLiteralExpr", "StrEx", "BLANK"), ("UnaryExpr", "UnaryExpr", "1"), ("Unknown", "Unknown", "BLANK"),
    ]
    assert len(R.SHORT_NAMES) == len(set(R.SHORT_NAMES.values()))


def test_leaves(spark):
    nodes = spark.createDataFrame([("NameExpr", 0, "x"), ("NameExpr", 1, "x"), ("LineComment", 0, "x"), ("EmptyStmt", 0, ";"), ("NameExpr", 0, ""), ("NameExpr", 0, "null"), ("NullLiteralExpr", 0, "null"), ("NameExpr", 0, None)], "kind string, n int, text string")
    assert [r.x for r in nodes.select(R.is_leaf(F.col("kind"), F.col("n"), F.col("text")).alias("x")).collect()] == [True, False, False, False, False, False, True, False]
    tokens = [("IdentifierToken", "x", ["IdentifierName"]), ("IdentifierToken", "var", ["IdentifierName", "VariableDeclaration", "LocalDeclarationStatement"]), ("IdentifierToken", "var", ["IdentifierName", "Argument"]), ("IntKeyword", "int", ["PredefinedType"]), ("CommaToken", ",", []), ("NumericLiteralToken", "1", ["Arg"]), ("IdentifierToken", "dummy", ["A"])]
    df = spark.createDataFrame(tokens, "kind string, text string, parents array<string>")
    assert [r.x for r in df.select(R.is_leaf_token(F.col("kind"), F.col("text"), F.col("parents"), ("dummy",)).alias("x")).collect()] == [True, False, True, True, False, True, False]


def test_texts_are_dealt_before_they_are_cut(spark):
    """As many partitions as the bytes of text want, and windows over the tokens shuffle nothing more."""
    rows = spark.createDataFrame([(k, "a = 1\n  b = 'é'\n" * 5) for k in range(40)], "sample_id bigint, code string")
    n = sum(len(r.code.encode()) for r in rows.collect())
    assert L.dealt(rows, held=100).rdd.getNumPartitions() == -(-n // 100)
    assert L.dealt(rows.limit(0)).rdd.getNumPartitions() == 1
    out = L.indented(L.mask_strings(L.by_rules(L.dealt(rows))), L.indent_styles(L.dealt(rows)))
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning(sample_id") == 2 and plan.count("REPARTITION_BY_NUM") == 2


def test_band_of_kept_tokens_equals_the_carried_matrix(spark):
    rng = random.Random(5)
    rows = [(s, k, rng.random() < 0.6 if rng.random() < 0.9 else None, rng.randrange(9)) for s in range(20) for k in range(rng.randrange(1, 12))]
    t = spark.createDataFrame(rows, "sample_id bigint, token_idx bigint, keep boolean, line int")
    cells = [(s, i, j, b - a) for s, i, _, a in rows for z, j, _, b in rows if s == z and abs(i - j) <= 2]
    matrix = spark.createDataFrame(cells, "sample_id bigint, i bigint, j bigint, value int")
    want = MK.masked(t, t.select("sample_id", "token_idx"), "keep", matrix)[2].collect()
    got = MK.masked_band(t, "keep", 2, lambda a, b: b - a, "line").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 50


def test_descents_of_whole_samples_equal_the_tightest_nodes(spark):
    """Spans that lie apart, touch and overlap; tokens without a span; a sample without a root."""
    rng = np.random.default_rng(8)
    nodes, tokens = [], []
    for s in range(12):
        nodes.append((s, 0, 1 if s == 11 else None, 0, 0, 400))
        spans = {0: (0, 400)}
        for k in range(1, 25):
            parent = int(rng.integers(0, k))
            lo, hi = spans[parent]
            step = max((hi - lo) // 4, 1)
            lo = lo + int(rng.integers(0, 4)) * step
            spans[k] = (lo, min(lo + step - (s % 2), hi))
            nodes.append((s, k, parent, k, *spans[k]))
        for t in range(40):
            start = int(rng.integers(0, 400))
            tokens.append((s, t, None if t == 7 else start, start + int(rng.integers(0, 3))))
    n = spark.createDataFrame(nodes, "sample_id bigint, node_id int, parent_id int, child_idx int, lo bigint, hi bigint")
    t = spark.createDataFrame(tokens, "sample_id bigint, token_idx int, start bigint, stop bigint")
    want = {tuple(r) for r in T.tightest_node(t, n.withColumn("size", F.struct((F.col("hi") - F.col("lo")).alias("lines"), F.lit(0).alias("cols")))).collect()}
    node = F.struct("node_id", "parent_id", F.col("child_idx").alias("place"), "lo", "hi", (F.col("hi") - F.col("lo")).cast("int").alias("lines"), F.lit(0).alias("cols"))
    lists = n.groupBy("sample_id").agg(F.collect_list(node).alias("nodes"))
    rows = t.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("token_idx", "start", "stop"))).alias("tokens")).join(lists, "sample_id")
    got = [tuple(r) for r in T.descents(rows).collect()]
    assert len(got) == len(set(got)) == len(want) and set(got) == want and len({x[2] for x in want}) > 5


def test_stage1_shuffles_texts_and_no_lexemes(spark, tmp_path):
    """What the map of tokens shuffles follows the texts: lexemes and pairs of tokens and nodes took dozens of times as much."""
    words = lambda k: " ".join(f"w{(k * 7919 + i * 104729) % 99991}" for i in range(400))
    text = [(k, 0, "user", words(k)) for k in range(60)]
    spark.createDataFrame(text, "conv_id bigint, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    before = shuffled()
    assert QUERIES["stage1_map"](spark, str(tmp_path)).count() > 20_000
    wrote = sum(v for k, v in shuffled().items() if k not in before)
    assert wrote < 10 * sum(len(r[3]) for r in text), wrote


def test_groups_that_share_and_cross_batches_are_worked_on_whole(spark):
    rows = spark.range(3000).selectExpr("cast(id % 7 as bigint) as k", "if(id % 3 = 0, null, cast(id % 2 as string)) as m", "id")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = grouped(rows, ["k", "m"], lambda t: pa.table({"k": t["k"][:1], "m": t["m"][:1], "n": pa.array([t.num_rows], pa.int64())}), "k bigint, m string, n bigint", 3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert sorted(map(str, got)) == sorted(map(str, rows.groupBy("k", "m").agg(F.count("*").alias("n")).collect()))
