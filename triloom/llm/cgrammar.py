"""Syntax of C and C++: a tokenizer, a preprocessor for one file, and a recursive-descent recogniser.

Nothing outside the file is known: included files are not read, no macro is predefined, and a name may be a type or a
value, whichever fits. So statements are tried as declarations, then as expressions. The recogniser only says whether a
text can be derived, and where it stops.
"""

from __future__ import annotations

import functools
import re

Token = tuple[str, str]  # kind (id, num, str, chr, op), text


class Invalid(Exception):
    pass


class Unbounded(Exception):
    """A bound was reached before the text was judged."""


class Undecided(str):
    """What kept a text from being judged."""


_OPS = "<<= >>= ... ->* <=> -> ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= :: .* ## { } ( ) [ ] ; , : ? . ~ ! + - * / % < > = & | ^ #".split()
_LEX = re.compile(
    r"""(?P<nl>\r\n|\n|\r)|(?P<ws>[ \t\f\v]+|//[^\r\n]*|/\*.*?\*/)|(?P<open>/\*)
    |(?P<raw>(?:u8|[uUL])?R"(?P<d>[^\s()\\"]{0,16})\(.*?\)(?P=d)")
    |(?P<str>(?:u8|[uUL])?"(?:\\.|[^"\\\r\n])*")|(?P<chr>(?:u8|[uUL])?'(?:\\.|[^'\\\r\n])+')
    |(?P<num>\.?[0-9](?:[eEpP][+-]|'[0-9A-Za-z_]|[\w.])*)|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>"""
    + "|".join(map(re.escape, _OPS))
    + r")|(?P<bad>.)",
    re.S | re.X,
)
_LEX_C = re.compile(_LEX.pattern.replace("(?P<raw>", "(?P<raw>(?!)"), re.S | re.X)
_NUM = re.compile(r"(?:0[xX][0-9a-fA-F]+|0[bB][01]+|0[0-7]*|[1-9][0-9]*)(?:[uU]?(?:ll|LL|[lLzZ])?|(?:ll|LL|[lLzZ])[uU])|(?:[0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(?=[eE]))(?:[eE][+-]?[0-9]+)?(?:[fFlLdD]|[fF](?:16|32|64|128)|[dD][fFdDlL])?|0[xX](?:[0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+[fFlL]?")

#: Key words of both languages, and those of C++ only.
C_WORDS = frozenset("auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local __attribute__ __extension__ __inline __inline__ __restrict __restrict__ __asm__ __asm asm __typeof__ typeof __volatile__ __const __signed__".split())
CPP_WORDS = C_WORDS - frozenset("restrict _Alignas _Alignof _Atomic _Generic _Noreturn _Static_assert _Thread_local typeof".split()) | frozenset("alignas alignof bool catch char8_t char16_t char32_t class concept const_cast consteval constexpr constinit decltype delete dynamic_cast explicit export false friend mutable namespace new noexcept nullptr operator private protected public reinterpret_cast requires static_assert static_cast template this thread_local throw true try typeid typename using virtual wchar_t".split())
STORAGE = frozenset("typedef extern static register auto inline __inline __inline__ _Noreturn _Thread_local thread_local __extension__ constexpr consteval constinit virtual explicit friend mutable".split())
QUALIFIERS = frozenset("const volatile restrict __restrict __restrict__ __volatile__ __const _Atomic".split())
ATTRIBUTES = frozenset("__attribute__ alignas _Alignas __declspec [ __asm__ asm __asm".split())
BUILTIN = frozenset("void char short int long float double signed unsigned _Bool _Complex _Imaginary __signed__ bool wchar_t char8_t char16_t char32_t".split())
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
BINARY = {op: i for i, ops in enumerate(("||", "&&", "|", "^", "&", "== !=", "<=>", "< > <= >=", "<< >>", "+ -", "* / %", ".* ->*")) for op in ops.split()}


def tokens(text: str, raw: bool) -> tuple[list[list[Token]], set[int]]:
    """The tokens of each line, without comments and spliced line ends; and the lines that define a macro with parameters. ``raw``: there are raw strings."""
    text = re.sub(r"\\[ \t]*(?:\r\n|\n|\r)", "", text.removeprefix("\ufeff"))
    lines: list[list[Token]] = [[]]
    calls: set[int] = set()
    last = -1
    for m in (_LEX if raw else _LEX_C).finditer(text):
        kind = m.lastgroup if m.lastgroup != "d" else "raw"
        if kind == "nl":
            lines.append([])
        elif kind == "open":
            raise Invalid("comment without end")
        elif kind != "ws":
            lines[-1].append(("str" if kind == "raw" else kind, m[0]))
            if len(lines[-1]) == 4 and m[0] == "(" and m.start() == last and lines[-1][1][1] == "define":
                calls.add(len(lines) - 1)  # no white space between the name and the bracket
            last = m.end()
    return lines, calls


class Preprocessor:
    """Conditionals and macros of one file."""

    LIMIT = 400_000  # tokens that expansion may add to those it began with
    USES = 4_000_000  # macros that may be expanded in one file

    def __init__(self):
        self.uses = 0
        self.macros: dict[str, tuple[list[str] | None, list[Token]]] = {}

    def run(self, lines: list[list[Token]], calls: set[int]) -> list[Token]:
        out: list[Token] = []
        held: list[Token] = []
        stack: list[list] = []  # taken so far, live, parent live, else seen
        live = True
        for at, line in enumerate(lines):
            if not line or line[0] != ("op", "#"):
                if live:
                    held += line
                continue
            if len(line) == 1:
                continue
            word, rest = line[1][1], line[2:]
            if word in ("if", "ifdef", "ifndef"):
                yes = live and self._holds(word, rest)
                stack.append([yes, live, False])
                live = yes
            elif word in ("elif", "elifdef", "elifndef", "else"):
                if not stack or stack[-1][2]:
                    raise Invalid(f"#{word} out of place")
                top = stack[-1]
                live = top[1] and not top[0] and (word == "else" or self._holds(word[2:], rest))
                top[0] |= live
                top[2] = word == "else"
            elif word == "endif":
                if not stack:
                    raise Invalid("#endif out of place")
                live = stack.pop()[1]
            elif not live:
                continue
            elif word == "define":
                out += self.expand(held)
                held = []
                self._define(rest, at in calls)
            elif word == "undef":
                out += self.expand(held)
                held = []
                if len(rest) != 1 or rest[0][0] != "id":
                    raise Invalid("#undef needs a name")
                self.macros.pop(rest[0][1], None)
            elif word in ("include", "include_next", "import", "embed"):
                if not rest or rest[0] not in (("op", "<"),) and rest[0][0] not in ("str", "id"):
                    raise Invalid("#include needs a file")
            elif line[1][0] == "num" or word not in ("pragma", "error", "warning", "line", "ident", "sccs", "assert", "unassert"):
                if line[1][0] != "num":
                    raise Invalid(f"#{word} is no directive")
        if stack:
            raise Invalid("#if without #endif")
        return out + self.expand(held)

    def _define(self, rest: list[Token], call: bool) -> None:
        if not rest or rest[0][0] != "id":
            raise Invalid("#define needs a name")
        name, body, params = rest[0][1], rest[1:], None
        if call:
            params, i = [], 1
            while i < len(body) and body[i] != ("op", ")"):
                if body[i][0] == "id" or body[i][1] == "...":
                    params.append(body[i][1])
                elif body[i][1] != ",":
                    raise Invalid(f"parameters of {name}")
                i += 1
            if i == len(body):
                raise Invalid(f"parameters of {name} without end")
            body = body[i + 1 :]
        self.macros[name] = (params, body)

    def _holds(self, word: str, rest: list[Token]) -> bool:
        if word in ("ifdef", "ifndef", "def", "ndef"):
            if not rest or rest[0][0] != "id":
                raise Invalid(f"#{word} needs a name")
            return (rest[0][1] in self.macros) == (not word.endswith("ndef"))
        out: list[Token] = []
        i = 0
        while i < len(rest):
            if rest[i][1] in ("defined", "__has_include", "__has_attribute", "__has_builtin"):
                bracket = i + 1 < len(rest) and rest[i + 1][1] == "("
                if rest[i][1] != "defined":
                    while i < len(rest) and rest[i][1] != ")":
                        i += 1
                    out.append(("num", "0"))
                    i += 1
                    continue
                at = i + 1 + bracket
                if at >= len(rest) or rest[at][0] != "id":
                    raise Invalid("defined needs a name")
                out.append(("num", str(int(rest[at][1] in self.macros))))
                i = at + 1 + bracket
            else:
                out.append(rest[i])
                i += 1
        return self._value(self.expand(out))

    @staticmethod
    def _value(ts: list[Token]) -> bool:
        words = []
        for kind, s in ts:
            if kind == "num":
                s = re.sub(r"[uUlLzZ]+$", "", s.replace("'", ""))
                words.append(str(int(s, 8) if re.fullmatch("0[0-7]+", s) else int(s, 0)) if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[bB][01]+|[0-9]+", s) and not re.fullmatch("0[0-9]*[89][0-9]*", s) else "(1/0)")
            elif kind == "id":
                words.append("1" if s == "true" else "0")
            elif kind == "chr":
                words.append("1")
            else:
                words.append({"&&": " and ", "||": " or ", "!": " not ", "/": "//"}.get(s, s))
        text = "".join(words)
        if "?" in text:  # a ? b : c, without brackets inside
            text = re.sub(r"(.*)\?(.*):(.*)", r"((\2) if (\1) else (\3))", text)
        try:
            if not text or "**" in text or not re.fullmatch(r"[0-9()+\-*/%<>=!&|^~, a-z]*", text):
                raise ValueError
            return bool(eval(text, {"__builtins__": {}}))  # only numbers and operators get here
        except ZeroDivisionError:
            return False
        except (MemoryError, OverflowError, RecursionError):
            raise Unbounded("#if condition too large") from None
        except Exception as e:
            if "too many nested" in str(e):
                raise Unbounded("#if condition nested too deeply") from None
            raise Invalid("#if without a proper condition") from None

    def expand(self, ts: list[Token], hidden: frozenset[str] = frozenset()) -> list[Token]:
        if not self.macros:
            return ts
        out: list[Token] = []
        i = 0
        while i < len(ts):
            kind, s = ts[i]
            i += 1
            if kind != "id" or s not in self.macros or s in hidden:
                out.append((kind, s))
                continue
            params, body = self.macros[s]
            self.uses += 1
            if self.uses > self.USES:
                raise Unbounded("too many macros expanded")
            if params is None:
                out += self.expand(self._paste(body, {}), hidden | {s})
            else:
                if i >= len(ts) or ts[i] != ("op", "("):
                    out.append((kind, s))
                    continue
                args, level, i = [[]], 1, i + 1
                while i < len(ts):
                    t = ts[i]
                    i += 1
                    if t[0] == "op":
                        level += (t[1] in "([{") - (t[1] in ")]}")
                        if level == 0:
                            break
                        if t[1] == "," and level == 1:
                            args.append([])
                            continue
                    args[-1].append(t)
                else:
                    raise Invalid(f"arguments of {s} without end")
                named: dict[str, list[Token]] = {}
                for k, p in enumerate(params):
                    if p == "...":
                        tail = args[k:]
                        named["__VA_ARGS__"] = [t for n, a in enumerate(tail) for t in ([("op", ",")] if n else []) + a]
                    else:
                        named[p] = args[k] if k < len(args) else []
                named = {p: self.expand(a, hidden) for p, a in named.items()}
                out += self.expand(self._paste(body, named), hidden | {s})
            if len(out) - i > self.LIMIT:
                raise Unbounded("expansion without bound")
        return out

    @staticmethod
    def _paste(body: list[Token], named: dict[str, list[Token]]) -> list[Token]:
        out: list[Token] = []
        i = 0
        while i < len(body):
            kind, s = body[i]
            if s == "#" and i + 1 < len(body) and body[i + 1][1] in named:
                out.append(("str", '""'))
                i += 2
            elif s == "##" and out and i + 1 < len(body):
                nxt = named.get(body[i + 1][1], [body[i + 1]])
                if nxt and out[-1][0] in ("id", "num") and nxt[0][0] in ("id", "num"):
                    out[-1] = (out[-1][0], out[-1][1] + nxt[0][1])
                    out += nxt[1:]
                elif nxt and out[-1][1] != ",":
                    out += nxt if nxt[0][0] != "op" else []
                else:
                    out += nxt
                i += 2
            else:
                out += named.get(s, [(kind, s)]) if kind == "id" else [(kind, s)]
                i += 1
        return out


END = ("end", "")


class Parser:
    """Recursive descent over preprocessed tokens. Methods raise Invalid where the grammar can't go on."""

    def __init__(self, ts: list[Token], cpp: bool):
        self.ts, self.cpp, self.i, self.far = [*ts, END], cpp, 0, 0
        self.words = CPP_WORDS if cpp else C_WORDS
        self.marks = [self.mark(t) for t in self.ts]
        self.kinds = [self.sort(t) for t in self.ts]
        self.most = 60 * len(self.ts) + 100_000
        self.steps = 0
        self.splits: list[tuple[int, Token]] = []

    # --- tokens
    @staticmethod
    def mark(t: Token) -> str:
        """A token as the grammar's rules name it; literals have no name."""
        return t[1] if t[0] not in ("str", "chr") else ""

    def sort(self, t: Token) -> str:
        return "word" if t[0] == "id" and t[1] in self.words else t[0]

    @property
    def s(self) -> str:
        return self.marks[self.i]

    def peek(self, k: int = 1) -> str:
        return self.marks[min(self.i + k, len(self.marks) - 1)]

    def kind(self, k: int = 0) -> str:
        return self.kinds[min(self.i + k, len(self.kinds) - 1)]

    def fail(self) -> None:
        self.far = max(self.far, self.i)
        raise Invalid(f"token {self.far}: {self.ts[min(self.far, len(self.ts) - 1)][1][:40]!r}")

    def next(self) -> None:
        self.i += 1
        self.steps += 1
        if self.steps > self.most:
            raise Unbounded("no derivation found within the bound")

    def take(self, s: str) -> bool:
        if self.marks[self.i] == s:
            self.next()
            return True
        return False

    def need(self, s: str) -> None:
        if s == ">" and self.s in (">>", ">=", ">>="):  # closes two template lists
            self.splits.append((self.i, self.ts[self.i]))
            self.put(self.i, 1, [("op", ">"), ("op", self.s[1:])])
        if not self.take(s):
            self.fail()

    def attempt(self, f, *args) -> bool:
        at, splits = self.i, len(self.splits)
        try:
            f(*args)
            return True
        except Invalid:
            self.far = max(self.far, self.i)
            self.rewind(at, splits)
            return False

    def rewind(self, at: int, splits: int) -> None:
        """Back to token ``at``, with the ``>>`` taken apart since then put together again."""
        while len(self.splits) > splits:
            i, token = self.splits.pop()
            self.put(i, 2, [token])
        self.i = at

    def put(self, at: int, n: int, tokens: list[Token]) -> None:
        """Other tokens in place of ``n``."""
        self.ts[at : at + n] = tokens
        self.marks[at : at + n] = [self.mark(t) for t in tokens]
        self.kinds[at : at + n] = [self.sort(t) for t in tokens]

    def balanced(self, close: str) -> None:
        """Anything up to ``close``, with brackets in pairs."""
        pairs = {"(": ")", "[": "]", "{": "}"}
        while self.s != close:
            if self.kind() == "end" or self.s in (")", "]", "}"):
                self.fail()
            s = self.s
            self.next()
            if s in pairs:
                self.balanced(pairs[s])
        self.next()

    # --- declarations
    def unit(self) -> None:
        while self.kind() != "end":
            self.external()

    def external(self) -> None:
        if self.take(";"):
            return
        if self.cpp and self.cpp_external():
            return
        if self.s in ("asm", "__asm__", "__asm") and self.peek() in ("(", "volatile", "__volatile__"):
            self.asm()
            return
        self.declaration(True)

    def asm(self) -> None:
        self.next()
        while self.s in ("volatile", "__volatile__", "goto", "inline"):
            self.next()
        self.need("(")
        self.balanced(")")
        self.need(";")

    def static_assert(self) -> None:
        self.next()
        self.need("(")
        self.expr_or_type()
        while self.take(","):
            self.assignment()
        self.need(")")
        self.need(";")

    def cpp_external(self) -> bool:
        if self.s == "inline" and self.peek() == "namespace":
            self.next()
        if self.take("namespace"):
            self.attributes()
            while self.kind() == "id":
                self.next()
                if not self.take("::"):
                    break
                self.take("inline")
            self.attributes()
            if self.take("="):
                self.qualified()
                self.need(";")
                return True
            self.block_of(self.external)
            return True
        if self.s == "extern" and self.kind(1) == "str":
            self.next()
            self.next()
            if self.s == "{":
                self.block_of(self.external)
            else:
                self.external()
            return True
        if self.s in ("template", "export"):
            self.take("export")
            self.need("template")
            if self.s == "<":
                self.template_parameters()
                self.requires()
                if self.take("concept"):
                    self.next()
                    self.need("=")
                    self.expression()
                    self.need(";")
                    return True
            self.external()
            return True
        if self.s == "using":
            self.using()
            return True
        return False

    def requires(self) -> None:
        if self.take("requires"):
            self.binary(0)

    def using(self) -> None:
        self.next()
        if self.take("namespace"):
            self.qualified()
        elif self.kind() == "id" and self.peek() in ("=", "["):
            self.next()
            self.attributes()
            self.need("=")
            self.type_name()
        else:
            self.take("typename")
            self.qualified()
            while self.take(","):
                self.qualified()
        self.need(";")

    def block_of(self, f) -> None:
        self.need("{")
        while not self.take("}"):
            if self.kind() == "end":
                self.fail()
            f()

    def template_parameters(self) -> None:
        self.need("<")
        while self.s != ">":
            if self.s in ("typename", "class") and (self.kind(1) == "id" and self.peek(2) in (",", ">", "=", ">>") or self.peek() in (",", ">", "...", "=", ">>")):
                self.next()
                self.take("...")
                if self.kind() == "id":
                    self.next()
                if self.take("="):
                    self.type_name()
            elif self.s == "template":
                self.next()
                self.template_parameters()
                self.next()
                self.take("...")
                if self.kind() == "id":
                    self.next()
                if self.take("="):
                    self.qualified()
            else:
                if not self.specifiers():
                    self.fail()
                self.take("...")
                self.declarator(True)
                if self.take("="):
                    self.binary(0, no_greater=True)
            if self.s in (">>", ">=", ">>="):
                break
            if not self.take(","):
                break
        self.need(">")

    def attributes(self) -> None:
        while self.marks[self.i] in ATTRIBUTES:
            if self.s == "__attribute__" or self.s in ("alignas", "_Alignas") or self.s == "__declspec":
                self.next()
                self.need("(")
                self.balanced(")")
            elif self.s == "[" and self.peek() == "[":
                self.next()
                self.next()
                self.balanced("]")
                self.need("]")
            elif self.s in ("__asm__", "asm", "__asm") and self.peek() == "(":
                self.next()
                self.next()
                self.balanced(")")
            else:
                return

    def value_arguments(self) -> None:
        """Template arguments within an expression: no operand may follow, else ``<`` and ``>`` compare."""
        self.template_arguments()
        if self.kind() in ("id", "num", "str", "chr", "word"):
            self.fail()

    def qualified(self, value: bool = False) -> None:
        """A name, in C++ with its qualifiers and template arguments; ``value``: within an expression."""
        if not self.cpp:
            if self.kind() != "id":
                self.fail()
            self.next()
            return
        self.take("::")
        while True:
            self.take("template")
            if self.s == "decltype":
                self.next()
                self.need("(")
                self.balanced(")")
            elif self.s == "operator":
                self.operator_name()
                return
            elif self.s == "~":
                self.next()
                if self.kind() != "id":
                    self.fail()
                self.next()
            elif self.kind() == "id":
                self.next()
            else:
                self.fail()
            if self.s == "<":
                self.attempt(self.value_arguments if value else self.template_arguments)
            if self.s == "::" and (self.kind(1) == "id" or self.peek() in ("~", "operator", "template")):
                self.next()
                continue
            return

    def operator_name(self) -> None:
        self.next()
        if self.s in ("(", "["):
            close = ")" if self.s == "(" else "]"
            self.next()
            self.need(close)
        elif self.s in ("new", "delete"):
            self.next()
            if self.take("["):
                self.need("]")
        elif self.kind() == "str":
            self.next()
            if self.kind() == "id":
                self.next()
        elif self.kind() == "op":
            if self.s in ("{", "}", ")", "]", ";", ":", "?", ".", "#", "##"):
                self.fail()
            self.next()
        else:
            self.type_name(no_function=True)

    def template_arguments(self) -> None:
        self.need("<")
        while self.s not in (">", ">>", ">=", ">>="):
            at, splits = self.i, len(self.splits)
            if not (self.attempt(self.type_name) and (self.take("...") or True) and self.s in (",", ">", ">>", ">=", ">>=")):
                self.rewind(at, splits)
                self.binary(0, no_greater=True)
                self.take("...")
            if not self.take(","):
                break
        self.need(">")

    def specifiers(self) -> bool:
        """Declaration specifiers; whether a type is among them."""
        typed = False
        builtin = False
        while True:
            self.attributes()
            s = self.s
            if s in STORAGE and self.kind() == "word" or s in QUALIFIERS and (self.kind() == "word" or s in ("const", "volatile")):
                if s == "explicit" and self.peek() == "(":
                    self.next()
                    self.next()
                    self.balanced(")")
                    continue
                if s == "_Atomic" and self.peek() == "(":
                    typed = True
                    self.next()
                    self.next()
                    self.balanced(")")
                    continue
                if s == "auto" and self.cpp:
                    typed = True
                self.next()
            elif s in BUILTIN and self.kind() == "word":
                if typed and not builtin:
                    return typed
                typed = builtin = True
                self.next()
            elif s in ("struct", "union", "class") and self.kind() == "word":
                if typed:
                    return typed
                typed = True
                self.record()
            elif s == "enum":
                if typed:
                    return typed
                typed = True
                self.enum()
            elif s in ("typeof", "__typeof__", "decltype") and self.kind() == "word":
                typed = True
                self.next()
                self.need("(")
                self.balanced(")")
            elif s == "typename" and self.cpp:
                typed = True
                self.next()
                self.qualified()
            elif not typed and (self.kind() == "id" or s == "::" and self.cpp):
                at, splits = self.i, len(self.splits)
                try:
                    self.qualified()
                except Invalid:
                    self.rewind(at, splits)
                    return typed
                if not self.after_type(at):
                    self.rewind(at, splits)
                    return typed
                typed = True
            else:
                return typed

    def after_type(self, at: int) -> bool:
        """Whether the name just read can be a type: what follows must be a declarator."""
        s, kind = self.s, self.kind()
        if kind == "id" or s in ("*", "&", "&&", "::", "...") or s in QUALIFIERS or s in STORAGE or s in BUILTIN or s in ("__attribute__", "operator", "struct", "enum", "class", "union"):
            return s != "..." or self.cpp
        if s == "(" and self.peek() in ("*", "&", "&&", "^"):
            return True
        if s == "[" and self.cpp and self.ts[at][1] == "auto":
            return True
        return self.bare and s in (",", ")", ">", ">>", "=", "[", ">=", ";", "{", "(") and self.ts[self.i - 1][1] != ")"

    bare = False  # a type may stand without a declarator here

    def record(self) -> None:
        cpp_class = self.cpp
        self.next()
        self.attributes()
        if self.kind() == "id" or self.s == "::" and self.cpp:
            self.qualified()
            if self.cpp and self.s == "final" :
                self.next()
            named = True
        else:
            named = False
        if cpp_class and self.s == ":" and named:
            self.next()
            while True:
                while self.s in ("public", "private", "protected", "virtual"):
                    self.next()
                self.qualified()
                self.take("...")
                if not self.take(","):
                    break
            if self.s != "{":
                self.fail()
        if self.s == "{":
            self.block_of(self.member)
        elif not named:
            self.fail()

    def member(self) -> None:
        if self.take(";"):
            return
        if self.cpp:
            if self.s in ("public", "private", "protected") and self.peek() == ":":
                self.next()
                self.next()
                return
            if self.s == "using":
                self.using()
                return
            if self.s == "template":
                self.next()
                self.template_parameters()
                self.requires()
                self.member()
                return
        if self.s in ("static_assert", "_Static_assert"):
            self.static_assert()
            return
        self.declaration(self.cpp, member=True)

    def enum(self) -> None:
        self.next()
        if self.cpp and self.s in ("class", "struct"):
            self.next()
        self.attributes()
        named = self.kind() == "id"
        if named:
            self.qualified()
        if self.s == ":" and (self.cpp or self.peek() in BUILTIN or self.kind(1) == "id"):
            at = self.i
            self.next()
            if not self.specifiers_bare():
                self.i = at
        if self.take("{"):
            while not self.take("}"):
                if self.kind() != "id":
                    self.fail()
                self.next()
                self.attributes()
                if self.take("="):
                    self.conditional()
                if not self.take(","):
                    self.need("}")
                    break
        elif not named:
            self.fail()

    def specifiers_bare(self) -> bool:
        old, self.bare = self.bare, True
        try:
            return self.specifiers()
        finally:
            self.bare = old

    def declaration(self, body: bool, member: bool = False, local: bool = False) -> None:
        if self.s in ("static_assert", "_Static_assert"):
            self.static_assert()
            return
        start = self.i
        old, self.bare = self.bare, False
        typed = self.specifiers()
        self.bare = old
        some = self.i > start
        if local and not typed and not (some and self.ts[start][1] in ("auto", "static", "const", "register")):
            self.fail()
        if self.take(";"):
            if not some:
                self.fail()
            return
        first = True
        while True:
            if member and self.s == ":":
                self.next()
                self.conditional()
            else:
                if self.cpp and self.s == "[" and typed:  # structured binding
                    self.next()
                    self.balanced("]")
                    shape = ""
                else:
                    shape = self.declarator(False)
                if not typed and not (shape and (self.cpp or first and body)):
                    self.fail()
                self.attributes()
                if member and self.s == ":" and not shape:
                    self.next()
                    self.conditional()
                if shape and self.cpp:
                    self.function_tail()
                if shape and first and body and not local:
                    if not self.cpp and self.s not in ("{", ";", ",", "="):
                        self.old_style()
                    if self.cpp and self.s == ":" :
                        self.initialisers()
                    if self.s == "{":
                        self.compound()
                        return
                    if self.cpp and self.s == "try":
                        self.next()
                        if self.s == ":":
                            self.initialisers()
                        self.compound()
                        self.handlers()
                        return
                if self.take("="):
                    if self.cpp and self.s in ("default", "delete"):
                        self.next()
                    else:
                        self.initialiser()
                elif self.cpp and self.s == "{" and not shape:
                    self.initialiser()
                elif self.cpp and self.s == "(" and not shape:
                    self.next()
                    self.arguments()
            first = False
            self.attributes()
            if not self.take(","):
                break
        self.need(";")

    def function_tail(self) -> None:
        while True:
            self.attributes()
            if self.s in ("const", "volatile", "&", "&&") or self.s in ("override", "final"):
                self.next()
            elif self.s in ("noexcept", "throw"):
                self.next()
                if self.take("("):
                    self.balanced(")")
            elif self.s == "->":
                self.next()
                self.type_name()
            elif self.s == "requires":
                self.requires()
            else:
                return

    def initialisers(self) -> None:
        self.next()
        while True:
            self.qualified()
            if self.s == "{":
                self.initialiser()
            else:
                self.need("(")
                self.arguments()
            self.take("...")
            if not self.take(","):
                return

    def handlers(self) -> None:
        if self.s != "catch":
            self.fail()
        while self.take("catch"):
            self.need("(")
            if not self.take("..."):
                if not self.specifiers_bare():
                    self.fail()
                self.declarator(True)
            self.need(")")
            self.compound()

    def old_style(self) -> None:
        while self.s != "{":
            start = self.i
            self.declaration(False)
            if self.i == start:
                self.fail()

    def pointers(self) -> None:
        while True:
            if self.s in ("*", "^") or self.cpp and self.s in ("&", "&&"):
                self.next()
            elif self.s in QUALIFIERS and self.kind() in ("word", "id"):
                self.next()
            elif self.cpp and self.kind() == "id" and self.peek() == "::" and self.member_pointer():
                pass
            else:
                self.attributes()
                if not (self.s in ("*", "^") or self.s in QUALIFIERS and self.kind() == "word"):
                    return

    def member_pointer(self) -> bool:
        k = 0
        while self.kind(k) == "id" and self.peek(k + 1) == "::":
            k += 2
        if self.peek(k) == "*":
            for _ in range(k + 1):
                self.next()
            return True
        return False

    def declarator(self, abstract: bool) -> str:
        """A declarator, with a name unless ``abstract``; returns ``f`` if it declares a function."""
        self.pointers()
        shape = ""
        if self.cpp:
            self.take("...")
        if self.s == "(" and (self.peek() in ("*", "^", "&", "&&", "(", "__attribute__") or self.kind(1) == "id" and (not abstract or self.peek(2) in ("::",)) ) and self.attempt(self.nested, abstract):
            pass
        elif self.kind() == "id" or self.cpp and self.s in ("operator", "~", "::"):
            self.qualified()
        elif not abstract:
            self.fail()
        self.attributes()
        while True:
            if self.s == "[" and not (self.peek() == "["):
                self.next()
                while self.s in ("static", "const", "volatile", "restrict", "__restrict"):
                    self.next()
                if self.s == "*" and self.peek() == "]":
                    self.next()
                elif self.s != "]":
                    self.expression()
                self.need("]")
                self.attributes()
            elif self.s == "(":
                if not self.attempt(self.parameters):
                    if self.cpp and not abstract:
                        return shape  # direct initialisation
                    self.fail()
                shape = shape or "f"
                self.attributes()
            else:
                return shape

    def nested(self, abstract: bool) -> None:
        self.need("(")
        self.attributes()
        self.declarator(abstract)
        self.need(")")

    def parameters(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            if self.take("..."):
                break
            old, self.bare = self.bare, True
            try:
                if self.cpp:
                    self.take("this")
                if not self.specifiers():
                    self.fail()
            finally:
                self.bare = old
            self.declarator(True)
            if self.cpp:
                self.function_tail()
                self.take("...")
            if self.cpp and self.take("="):
                self.initialiser()
            if not self.take(","):
                break
        self.need(")")

    def type_name(self, no_function: bool = False) -> None:
        old, self.bare = self.bare, True
        try:
            if not self.specifiers():
                self.fail()
        finally:
            self.bare = old
        if no_function:
            self.pointers()
        else:
            self.declarator(True)

    def initialiser(self) -> None:
        if not self.take("{"):
            self.assignment()
            return
        while not self.take("}"):
            designated = False
            while self.s in (".", "[") and (self.s == "." or not self.cpp or self.peek() != "]"):
                at = self.i
                if self.take("."):
                    self.next()
                else:
                    self.next()
                    try:
                        self.conditional()
                        if self.take("..."):
                            self.conditional()
                        self.need("]")
                    except Invalid:
                        self.i = at
                        break
                designated = True
                if self.s in ("=", "{"):
                    break
                if self.s not in (".", "["):
                    self.i = at
                    designated = False
                    break
            if designated:
                self.take("=")
            elif self.kind() == "id" and self.peek() == ":" and not self.cpp:
                self.next()
                self.next()
            self.initialiser()
            self.take("...")
            if not self.take(","):
                self.need("}")
                return

    # --- statements
    def compound(self) -> None:
        self.block_of(self.statement)

    def statement(self) -> None:
        s = self.s
        if s == "{":
            self.compound()
        elif s == ";":
            self.next()
        elif s in ("if", "while", "switch"):
            self.next()
            if self.cpp:
                self.take("constexpr")
            self.need("(")
            self.condition()
            self.need(")")
            self.statement()
            if s == "if" and self.take("else"):
                self.statement()
        elif s == "for":
            self.next()
            self.need("(")
            self.for_head()
            self.need(")")
            self.statement()
        elif s == "do":
            self.next()
            self.statement()
            self.need("while")
            self.need("(")
            self.expression()
            self.need(")")
            self.need(";")
        elif s == "return" or self.cpp and s in ("co_return", "co_yield"):
            self.next()
            if self.s != ";":
                if self.s == "{" and self.cpp:
                    self.initialiser()
                else:
                    self.expression()
            self.need(";")
        elif s in ("break", "continue"):
            self.next()
            self.need(";")
        elif s == "goto":
            self.next()
            if self.take("*"):
                self.expression()
            elif self.kind() == "id":
                self.next()
            else:
                self.fail()
            self.need(";")
        elif s == "case":
            self.next()
            self.conditional()
            if self.take("..."):
                self.conditional()
            self.need(":")
            self.labelled()
        elif s == "default" and self.peek() == ":":
            self.next()
            self.next()
            self.labelled()
        elif self.kind() == "id" and self.peek() == ":" and self.peek(2) != ":":
            self.next()
            self.next()
            self.attributes()
            self.labelled()
        elif s in ("asm", "__asm__", "__asm"):
            self.asm()
        elif self.cpp and s == "try":
            self.next()
            self.compound()
            self.handlers()
        elif self.cpp and s == "using":
            self.using()
        elif self.cpp and s == "namespace":
            self.cpp_external()
        elif s in ("static_assert", "_Static_assert"):
            self.static_assert()
        elif s == "else":
            self.fail()
        else:
            self.attributes()
            if not self.attempt(self.declaration, False, False, True):
                self.expression()
                self.need(";")

    def labelled(self) -> None:
        if self.s != "}":
            self.statement()

    def condition(self) -> None:
        at, splits = self.i, len(self.splits)
        if self.cpp and self.attempt(self.condition_declaration) and self.s == ")":
            return
        self.rewind(at, splits)
        if self.cpp and self.attempt(self.for_init) and self.ts[self.i - 1][1] == ";":
            self.condition()
            return
        self.rewind(at, splits)
        self.expression()

    def condition_declaration(self) -> None:
        if not self.specifiers():
            self.fail()
        self.declarator(False)
        if self.s == "{":
            self.initialiser()
        else:
            self.need("=")
            self.initialiser()

    def for_init(self) -> None:
        if not self.attempt(self.declaration, False, False, True):
            self.expression()
            self.need(";")

    def for_head(self) -> None:
        at = self.i
        if self.cpp and self.attempt(self.for_range):
            return
        self.i = at
        if not self.take(";"):
            self.for_init()
        if self.s != ";":
            if not (self.cpp and self.attempt(self.condition_declaration)):
                self.expression()
        self.need(";")
        if self.s != ")":
            self.expression()

    def for_range(self) -> None:
        if not self.specifiers():
            self.fail()
        if self.s == "&" or self.s == "&&":
            self.next()
        if self.s == "[":
            self.next()
            self.balanced("]")
        else:
            self.declarator(False)
        self.need(":")
        self.initialiser()

    # --- expressions
    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        if self.cpp and self.s == "throw":
            self.next()
            if self.s not in (";", ")", ",", ":"):
                self.assignment()
            return
        self.conditional()
        if self.s in ASSIGN:
            self.next()
            if self.cpp and self.s == "{":
                self.initialiser()
            else:
                self.assignment()

    def conditional(self) -> None:
        self.binary(0)
        if self.take("?"):
            if self.s != ":":
                self.expression()
            self.need(":")
            self.assignment() if self.cpp else self.conditional()

    def binary(self, least: int, no_greater: bool = False) -> None:
        while True:
            self.unary()
            op = self.s
            if op not in BINARY or BINARY[op] < least or no_greater and op in (">", ">>", ">="):
                return
            if op in (".*", "->*", "<=>") and not self.cpp:
                self.fail()
            self.next()
            if self.cpp and self.s == "..." :  # fold
                self.next()
                if self.s == ")":
                    return
                if self.s in BINARY:
                    self.next()

    def unary(self) -> None:
        s = self.s
        if s in ("+", "-", "!", "~", "*", "&", "++", "--", "&&", "__extension__"):
            if s == "&&" and (self.cpp or self.kind(1) != "id"):
                self.fail()
            self.next()
            self.unary()
        elif s in ("sizeof", "_Alignof", "alignof", "__alignof__") and self.kind() in ("word", "id") and s != "":
            self.next()
            if self.cpp and self.take("..."):
                pass
            if self.s == "(" and self.attempt(self.bracketed_type):
                if self.s == "{":
                    self.initialiser()
                self.postfix_tail()
            else:
                self.unary()
        elif s == "(" and self.attempt(self.cast):
            pass
        elif self.cpp and s == "new" or self.cpp and s == "::" and self.peek() == "new":
            self.take("::")
            self.new()
        elif self.cpp and s == "delete" or self.cpp and s == "::" and self.peek() == "delete":
            self.take("::")
            self.next()
            if self.take("["):
                self.need("]")
            self.unary()
        elif self.cpp and s == "noexcept":
            self.next()
            self.need("(")
            self.expression()
            self.need(")")
        elif self.cpp and s in ("co_await",):
            self.next()
            self.unary()
        else:
            self.primary()
            self.postfix_tail()

    def bracketed_type(self) -> None:
        self.need("(")
        self.type_name()
        self.need(")")

    def cast(self) -> None:
        """``(type) operand`` or ``(type) { .. }``."""
        self.bracketed_type()
        if self.s == "{":
            self.initialiser()
            self.postfix_tail()
            return
        name = self.ts[self.i - 2]
        plain = name[0] == "id" and name[1] not in self.words and self.ts[self.i - 3][1] == "("
        if plain and self.s in ("+", "-", "*", "&", "&&", "++", "--", "[", ".", "->"):
            self.fail()  # (name) - x: a value in brackets serves as well
        self.unary()

    def new(self) -> None:
        self.next()
        if self.s == "(":
            at = self.i
            self.next()
            if not self.attempt(self.arguments) or self.s in (";", ",", ")"):
                self.i = at
        if self.s == "(":
            self.bracketed_type()
        else:
            if not self.specifiers_bare():
                self.fail()
            self.pointers()
            while self.take("["):
                if self.s != "]":
                    self.expression()
                self.need("]")
        if self.take("("):
            self.arguments()
        elif self.s == "{":
            self.initialiser()

    def arguments(self) -> None:
        """What is left of an argument list after the opening bracket."""
        if self.take(")"):
            return
        while True:
            if self.s == "{" and self.cpp:
                self.initialiser()
            else:
                self.expr_or_type()
            self.take("...")
            if not self.take(","):
                break
        self.need(")")

    def expr_or_type(self) -> None:
        at, splits = self.i, len(self.splits)
        if self.attempt(self.assignment) and self.s in (",", ")", "..."):
            return
        self.rewind(at, splits)
        if self.attempt(self.type_name):
            return
        self.assignment()

    def postfix_tail(self) -> None:
        while True:
            s = self.s
            if s == "[":
                self.next()
                if self.cpp and self.s == "{":
                    self.initialiser()
                else:
                    self.expression()
                self.need("]")
            elif s == "(":
                self.next()
                self.arguments()
            elif s in (".", "->"):
                self.next()
                if self.cpp:
                    self.take("template")
                    self.qualified(True)
                elif self.kind() == "id":
                    self.next()
                else:
                    self.fail()
            elif s in ("++", "--"):
                self.next()
            elif s == "{" and self.cpp and self.brace_init:
                self.initialiser()
            else:
                return
            self.brace_init = False

    brace_init = False

    def primary(self) -> None:
        kind, s = self.kind(), self.s
        self.brace_init = False
        if kind == "num":
            text = s.replace("'", "")
            if not _NUM.fullmatch(text) and not (self.cpp and re.fullmatch(r"(?:0[xX][0-9a-fA-F]+|[0-9.]+(?:[eE][+-]?[0-9]+)?)_?[A-Za-z]\w*", text) and "_" in text):
                self.fail()
            self.next()
        elif kind in ("str", "chr"):
            if kind == "chr":
                self.next()
            else:
                while self.kind() == "str" or self.kind() == "id" and self.kind(1) == "str" and self.s.isupper():
                    self.next()
                if self.kind() == "id" and self.s.isupper() and self.ts[self.i - 1][0] == "str" or self.cpp and self.kind() == "id" and self.s.startswith("_"):
                    self.next()  # "%" PRIu64, or a suffix
        elif s == "(":
            self.next()
            if self.s == "{":  # statement expression
                self.compound()
            elif self.cpp and self.take("..."):
                self.next()
                self.unary()
            else:
                self.expression()
            self.need(")")
        elif s == "_Generic" and not self.cpp:
            self.next()
            self.need("(")
            self.balanced(")")
        elif kind == "id" or self.cpp and s == "::":
            while not self.cpp and kind == "id" and s.isupper() and self.kind(1) == "str":  # PREFIX "text"
                self.next()
                while self.kind() == "str":
                    self.next()
                return
            self.qualified(True)
            self.brace_init = self.cpp and self.ts[self.i - 1][0] in ("id", "op") and self.ts[self.i - 1][1] != ")"
        elif self.cpp and s in ("this", "true", "false", "nullptr"):
            self.next()
        elif self.cpp and s in ("static_cast", "dynamic_cast", "reinterpret_cast", "const_cast"):
            self.next()
            self.need("<")
            self.type_name()
            self.need(">")
            self.need("(")
            self.expression()
            self.need(")")
        elif self.cpp and s == "typeid":
            self.next()
            self.need("(")
            self.expr_or_type()
            self.need(")")
        elif self.cpp and s == "[":
            self.lambda_()
        elif self.cpp and s == "operator":
            self.qualified()
        elif self.cpp and s == "requires":
            self.next()
            if self.take("("):
                self.balanced(")")
            self.need("{")
            self.balanced("}")
        elif self.cpp and (s in BUILTIN or s == "typename" or s == "decltype"):
            if s in BUILTIN:
                while self.s in BUILTIN:
                    self.next()
            else:
                self.specifiers_bare()
            if self.s not in ("(", "{"):
                self.fail()
            self.brace_init = True
        else:
            self.fail()

    def lambda_(self) -> None:
        self.need("[")
        while self.s != "]":
            if self.s in ("=", "&", "*", "..."):
                self.next()
            elif self.kind() == "id" or self.s == "this":
                self.next()
                if self.s in ("=", "{", "("):
                    self.take("=")
                    self.initialiser() if self.s != "(" else self.unary()
            elif not self.take(","):
                self.fail()
        self.next()
        if self.s == "<":
            self.template_parameters()
        if self.s == "(":
            self.parameters()
        while self.s in ("mutable", "constexpr", "static"):
            self.next()
        self.function_tail()
        self.compound()


@functools.lru_cache(maxsize=1)
def _prepared(text: str, raw: bool) -> list[Token]:
    """The tokens that the grammar sees. Both languages have the same but for raw strings, so a text without any is prepared once for both."""
    ts = Preprocessor().run(*tokens(text, raw))
    for kind, s in ts:
        if kind == "bad" or s in ("#", "##"):
            raise Invalid(f"stray {s[:20]!r}")
    return ts


def check(text: str, cpp: bool) -> str | None:
    """None if ``text`` is C, or C++, by its syntax; else what is wrong, as :class:`Undecided` if a bound was reached."""
    try:
        Parser(_prepared(text, cpp and 'R"' in text), cpp).unit()
    except Invalid as e:
        return str(e)
    except Unbounded as e:
        return Undecided(e)
    except RecursionError:
        return Undecided("nested too deeply")
    return None
