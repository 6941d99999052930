"""Source files that do not parse, with the cause: every file against all grammars, ranked by its tokens.

Files are independent, so the plan is one pass without a shuffle; only the rates are aggregated.
"""

from __future__ import annotations

import ast
import json
import re
import sys
import warnings
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triloom.llm import cgrammar
from triloom.session import arrow, col

#: The language of each extension.
EXTENSIONS = {".c": "c", ".h": "c", ".cc": "c++", ".cpp": "c++", ".py": "python", ".json": "json"}
LANGUAGES = ["c", "c++", "python", "json"]
#: A token, for ranking: a word, an operator of two characters that tells languages apart, a string, or any other mark.
TOKEN = re.compile(r"""[^\W\d]\w*|::|->|\+\+|--|&&|\|\||<<|>>|"(?:[^"\\\n]|\\.)*"\s*:|"(?:[^"\\\n]|\\.)*"|[^\w\s]""")
#: Tokens that speak for a language.
SIGNS = {
    "c": "int char void struct static return unsigned long short sizeof typedef enum union extern const goto switch case break include define ifdef endif NULL ; -> { } && || ++ *".split(),
    "c++": "class template namespace public private protected virtual typename using operator new delete nullptr bool auto const std string vector override int char void return include define ; :: -> { } && || ++ << >>".split(),
    "python": "def class import from if elif else for in while with as try except finally raise return yield lambda pass self None True False and or not is : # @".split(),
    "json": "true false null { }".split(),
}
#: A sign of k languages counts 1 / k for each; a string before a colon, as keys in JSON are, counts KEY.
WEIGHTS = {x: {t: 1 / sum(t in other for other in SIGNS.values()) for t in signs} for x, signs in SIGNS.items()}
KEY = 2
_CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)|^={7}$", re.M)
_ATOM = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![\w.+-]))')


def python_error(text: str) -> str | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text.removeprefix("\ufeff"), "file", "exec", ast.PyCF_ONLY_AST, dont_inherit=True)
    except (SyntaxError, ValueError) as e:
        return f"{type(e).__name__}: {getattr(e, 'msg', e)}"[:200]
    except (RecursionError, MemoryError):
        return cgrammar.Undecided("nested too deeply")
    return None


def json_error(text: str) -> str | None:
    def constant(name: str) -> None:
        raise ValueError(f"{name} is no value")

    try:
        json.loads(text.removeprefix("\ufeff"), parse_constant=constant, parse_int=len, parse_float=len)
    except ValueError as e:
        return str(e)[:200]
    except RecursionError:
        return _deep_json_error(text.removeprefix("\ufeff"))
    return None


def _deep_json_error(text: str) -> str | None:
    """The same for nesting of any depth, with a stack of our own."""
    stack: list[str] = []
    want = "value"  # value, first (value or ]), key, firstkey (key or }), colon, after
    i = 0
    while True:
        m = _ATOM.match(text, i)
        if not m:
            return None if want == "after" and not stack and not text[i:].strip(" \t\n\r") else f"char {i}: nothing that fits"
        i = m.end()
        mark, string, _ = m.groups()
        if want in ("value", "first") and mark in ("[", "{"):
            stack.append(mark)
            want = "first" if mark == "[" else "firstkey"
        elif want in ("value", "first") and mark is None:
            want = "after"
        elif want in ("key", "firstkey") and string:
            want = "colon"
        elif want == "colon" and mark == ":":
            want = "value"
        elif want == "after" and stack and mark == ",":
            want = "value" if stack[-1] == "[" else "key"
        elif stack and (mark == "]" and stack[-1] == "[" and want in ("after", "first") or mark == "}" and stack[-1] == "{" and want in ("after", "firstkey")):
            stack.pop()
            want = "after"
        else:
            return f"char {i}: {want} expected"


def error(text: str, language: str) -> str | None:
    """None if ``text`` is syntactically valid in ``language``, else what is wrong, as ``Undecided`` if a bound was reached."""
    if language == "python":
        return python_error(text)
    if language == "json":
        return json_error(text)
    return cgrammar.check(text, language == "c++")


def ranked(text: str) -> list[str]:
    """The languages, likeliest first, by the share of the text's tokens that speak for them."""
    counts = Counter(TOKEN.findall(text))
    score = {x: sum(w * counts[t] for t, w in signs.items()) for x, signs in WEIGHTS.items()}
    score["json"] += KEY * sum(n for t, n in counts.items() if t[0] == '"' and t[-1] == ":")
    return sorted(LANGUAGES, key=lambda x: (-score[x], LANGUAGES.index(x)))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))
    for batch in batches:
        rows = []
        for language, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if text is None:
                rows.append((None, None, None, None, None))
                continue
            order = ranked(text)
            errors = {x: error(text, x) for x in order}
            fits = [x for x in order if errors[x] is None]
            if language is None:
                rows.append((None, fits[0] if fits else None, fits, None, None))
            elif errors[language] is None:
                rows.append((False, language, fits, None, None))
            elif isinstance(errors[language], cgrammar.Undecided):
                rows.append((None, None, fits, "undecided", errors[language]))
            elif fits:
                rows.append((True, fits[0], fits, "wrong extension", errors[language]))
            else:
                rows.append((True, None, fits, "merge conflict" if _CONFLICT.search(text) else "undecided" if any(isinstance(e, cgrammar.Undecided) for e in errors.values()) else "corrupt", errors[language]))
        cols = list(zip(*rows)) or [()] * 5
        types = [pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
        names = ["invalid", "actual", "parses", "cause", "message"]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(list(c), t) for c, t in zip(cols, types)], batch.column(3)], ["src_id", "language", *names, "repo"])


def check_sources(df: DataFrame, src_id: str = "src_id", file: str = "curr_file", content: str = "content", repo: str = "repo") -> DataFrame:
    """A flag for every file: src_id, language (by extension), invalid, actual (likeliest language it parses as), parses (all of them, likeliest first), cause, message, repo.

    ``invalid`` is null for null content, an extension that isn't supported, or a file whose own grammar reached a bound
    before it could judge; ``cause`` is then ``undecided``, as it is for an invalid file that another grammar could not
    judge. Else ``cause`` is ``wrong extension`` if
    another grammar takes the file, ``merge conflict`` if none does and it has conflict markers, else ``corrupt``. An empty
    file is valid C, C++ and Python, and invalid JSON. Repeated rows are each judged; whole texts are parsed. Other
    columns of ``df`` are not carried along.
    """
    ext = F.lower(F.regexp_extract(col(df, file), r"(\.[^./\\]+)$", 1))
    language = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[F.coalesce(ext, F.lit(""))]
    rows = df.select(col(df, src_id).cast("long").alias("src_id"), language.alias("language"), col(df, content).alias("content"), col(df, repo).cast("string").alias("repo"))
    return rows.transform(arrow, _judge, "src_id long, language string, invalid boolean, actual string, parses array<string>, cause string, message string, repo string")


def error_rates(judged: DataFrame) -> DataFrame:
    """For each repo and language: files judged, invalid ones, those of each cause, and the rate."""
    known = judged.where("invalid is not null")
    per = known.groupBy("repo", "language").agg(F.count("*").alias("n_files"), F.count_if("invalid").alias("n_invalid"), F.count_if(F.col("cause") == "wrong extension").alias("n_wrong_extension"), F.count_if(F.col("cause") == "merge conflict").alias("n_conflict"))
    return per.withColumn("rate", F.col("n_invalid") / F.col("n_files"))
