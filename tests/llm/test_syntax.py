import pytest

from triloom.llm.cgrammar import check
from triloom.llm.syntax import _deep_json_error, check_sources, error, error_rates, json_error, ranked

BOTH = [
    "", ";", "int x;", "int main(void) { return 0; }", "typedef struct s { int a : 3, b; struct s *next; } s_t;", "static const char *const names[] = { \"a\", [3] = \"b\" };" , "enum e { A, B = 2, };", "int (*fp)(int, char *);",
    "foo_t *f(bar_t x, ...) { foo_t *p = (foo_t *) x; return p->q[1].r++; }", "void f() { for (int i = 0; i < 10; i++) { if (x) continue; else break; } do x--; while (x); switch (x) { case 1: default: ; } goto l; l: ; }",
    "#define M(a, b) do { a; b; } while (0)\nvoid f(void) { M(x = 1, g(2)); }", "#if 0\nthis isn't {\n#endif\nint x;", "#ifdef WIDE\nint f(int a, int b) {\n#else\nint f(int a) {\n#endif\n return a; }", "int x = 0x1fUL + 07 + 1e3f + .5 + 'c' + '\\'';",
    "int a = sizeof(int *) + sizeof x;", "unsigned long long x = (unsigned) -1;", "/* } */ int x; // {\n", "int f(a, b) ;", "struct { int x; } y = { .x = 1 };", "char *s = \"a\" \"b\\\"\";", "#define BEGIN {\n#define END }\nvoid f(void) BEGIN END", "void f(void) { a * b; (a)(b); x = (t) y; z = a ? b : c, d; }",
    "int x\\\n;", "#define V (1)\nint x = V;", "#define F(...) f(__VA_ARGS__)\nint g(void) { return F(1, 2); }", "extern int f(const struct a *restrict_, size_t n) __attribute__((nonnull));", "#include <x.h>\n#pragma once\n#error no\n".replace("#error no\n", ""),
]
C_ONLY = ["int new, class; void f(int *restrict p) { int this = 1; }", "int f(a, b) int a; char *b; { return a; }", "int template(int n) { return n; }"]
CPP_ONLY = [
    "namespace a { template <typename T, int N = 3> class B : public C<T> { public: explicit B(T v) : v_(v), w_{1} {} virtual ~B() = default; T get() const { return v_; } private: T v_; int w_; }; }", "auto f = [&](int x) -> int { return x + 1; };", "std::vector<std::vector<int>> v = {{1, 2}, {3}};",
    "void f() { for (auto &x : xs) { delete x; } try { throw E(1); } catch (const E &e) { } catch (...) { } }", "const char *s = R\"x(a \" { )\" )x\";", "template <class T> T g(T a) { return static_cast<T>(a) << 1; }", "int A::f(int &&x) noexcept { return B<int>::g(x); }", "using t = int; using namespace std; enum class E : int { A };", "bool operator==(const A &a, const A &b) { return a.x < b.x && a.y > b.y; }", "int *p = new int[3]; A a(1), b{2};",
]
NEITHER = [
    "int main(void) {", "}", "int x", "int f(int a { }", "int f(void) { return 0 }", "void f(void) { if x) y; }", "<<<<<<< HEAD\nint x;\n=======\nint y;\n>>>>>>> b\n", "int x;\n=======\n", "int x = ;", "#if 1\nint x;", "#endif\n", "#else\n", "int x; /* open", "char *s = \"open;\n", "<html><body>no</body></html>",
    "\x7fELF\x02\x01", "def f(x):\n    return x\n", '{"a": [1, 2]}', "--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n int x;\n-int y;\n+int z;\n", "int 3x;", "void f(void) { else { } }", "void f(void) { g(1, ; }", "int a[3;", "struct s { int a; ", "int x = 12abc;", "int x = 089;", "#foo\n", "#define F(a\nint x;", "#define B {\nvoid f(void) B", "void f(void) { x = y z; }",
]


@pytest.mark.parametrize("text", BOTH + C_ONLY)
def test_c(text):
    assert check(text, False) is None


@pytest.mark.parametrize("text", BOTH + CPP_ONLY)
def test_cpp(text):
    assert check(text, True) is None


@pytest.mark.parametrize("text", NEITHER)
def test_neither(text):
    assert check(text, False) is not None and check(text, True) is not None


def test_only_one_of_both():
    assert all(check(t, True) is not None for t in C_ONLY) and all(check(t, False) is not None for t in CPP_ONLY if not t.startswith("using"))


def test_every_cut_of_a_function_fails():
    text = "static int f(char *data, int len)\n{\n    int i = 0;\n    for (i = 0; i < len; i++) {\n        g(data , i);\n    }\n    return i;\n}\n"
    for n in range(len("static int f("), len(text) - 2):
        assert check(text[:n], False) is not None, text[:n]


def test_json():
    assert all(json_error(t) is None and _deep_json_error(t) is None for t in ("{}", " [1, -2.5e3, \"a\\u00e9\", null, true]\n", "3", '"x"', '{"a": {"b": []}}', "1" * 5000))
    bad = ("", "{", "[1,]", "{'a': 1}", "NaN", "[Infinity]", '{"a" 1}', '{"a": 1,}', "[1] 2", '"\x01"', "01", "nul", "[1}", "{1: 2}", '["\\x"]')
    assert all(json_error(t) is not None and _deep_json_error(t) is not None for t in bad)
    assert json_error("[" * 200_000 + "]" * 200_000) is None and json_error("[" * 200_000) is not None


def test_python_and_ranking():
    assert error("def f(x):\n\treturn x\r\n", "python") is None and error("print 'x'", "python") and error("x = (", "python") and error("a\0b", "python")
    assert ranked("def f(x):\n    return x\nimport os\n")[0] == "python" and ranked('{\n  "a": 1,\n  "b": [true]\n}')[0] == "json"


def test_files(spark):
    rows = [
        (1, "r", "a.c", "int x;"), (2, "r", "a.c", "def f(x):\n    return x\n"), (3, "r", "b.H", "int x"), (4, None, "a.py", None), (5, "r", "a.json", ""), (6, "r", "a.txt", "int x;"), (7, "r", None, "{}"),
        (8, "q", "x.y.cpp", "<<<<<<< a\nint x;\n=======\n>>>>>>> b\n"), (None, "q", "a.py", ""), (9, "q", "b.c", "int x;\n" * 20_000), (1, "r", "a.c", "int x;"), (10, "q", "deep.c", "int x = " + "(" * 3000 + "1" + ")" * 3000 + ";"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "src_id long, repo string, curr_file string, content string, language string")
    judged = check_sources(df)
    got = {r.src_id: (r.language, r.invalid, r.actual, r.cause) for r in judged.collect()}
    assert got[1] == ("c", False, "c", None) and got[2] == ("c", True, "python", "wrong extension") and got[3] == ("c", True, None, "corrupt")
    assert got[4] == ("python", None, None, None) and got[5][1] and got[6][:2] == (None, None) and got[7][:2] == (None, None) and got[8][1] and got[8][3] == "merge conflict"
    assert got[None][:2] == ("python", False) and got[9][1] is False and got[10][1] is False
    rates = {(r.repo, r.language): (r.n_files, r.n_invalid, r.n_wrong_extension) for r in error_rates(judged).collect()}
    assert rates["r", "c"] == (4, 2, 1)
    assert check_sources(df.limit(0)).count() == 0


def test_long_files_are_judged_and_bounds_are_no_errors():
    from triloom.llm.cgrammar import Undecided

    assert check("#define N 1\nint a[] = {" + "1," * 210_000 + "N};\n", False) is None  # plain tokens are no expansion
    assert check("#if " + "||".join(["0"] * 12_000) + "\nint a;\n#endif\n", False) is None
    assert isinstance(check("#if " + "+".join(["1"] * 60_000) + "\n#endif\n", False), Undecided)
    deep = "#define M0 int a;\n" + "".join(f"#define M{i} M{i - 1}\n" for i in range(1, 100)) + "M99\n"
    assert check(deep, False) is None
    broken = deep.replace("int a;", "int int ) a;")
    assert check(broken, False) is not None and not isinstance(check(broken, False), Undecided)
    endless = "#define M0 1,\n" + "".join(f"#define M{i} M{i - 1} M{i - 1}\n" for i in range(1, 25)) + "int a[] = {M24};\n"
    assert isinstance(check(endless, False), Undecided)


def test_undecided_files_are_not_flagged(spark):
    from triloom.llm.syntax import check_sources, error_rates

    endless = "#define M0 1,\n" + "".join(f"#define M{i} M{i - 1} M{i - 1}\n" for i in range(1, 25)) + "int a[] = {M24};\n"
    df = spark.createDataFrame([(1, "a.c", endless, "r"), (2, "b.c", "int a;", "r")], "src_id long, curr_file string, content string, repo string")
    judged = check_sources(df)
    assert sorted((r.src_id, r.invalid, r.cause) for r in judged.collect()) == [(1, None, "undecided"), (2, False, None)]
    assert [r.n_files for r in error_rates(judged).collect()] == [1]
