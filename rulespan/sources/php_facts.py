"""Facts of PHP files: classes with their members and dependencies, references, instantiations and
side effects. One pass over a file's tokens; Spark runs it on batches of files."""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from rulespan import schemas
from rulespan.operators.files import has_bom, is_utf8
from rulespan.operators.graph import cut
from rulespan.sources.facts import TABLES, _fields
from rulespan.sources.php_tokens import SyntaxProblem, Token, tokenize

# Fixed values of the language.
BUILTIN_TYPES = frozenset("int string bool float array callable iterable object mixed void never null false true self static parent".split())
RESERVED = frozenset("abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile "
                     "enum extends final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new or print "
                     "private protected public readonly require require_once return static switch throw trait try unset use var while xor yield from eval exit die self parent".split())
SUPERGLOBALS = frozenset("$_GET $_POST $_COOKIE $_REQUEST $_SERVER $_SESSION $_ENV $_FILES $GLOBALS".split())
CONSTRUCTS = {k: k for k in "echo print isset empty unset eval list exit die include include_once require require_once".split()}
BRANCHES = frozenset("if elseif for foreach while do case default catch and or".split())
MODIFIERS = frozenset("public protected private static abstract final readonly var".split())
MAGIC = frozenset("__construct __destruct __call __callstatic __get __set __isset __unset __sleep __wakeup __serialize __unserialize __tostring __invoke __set_state __clone __debuginfo".split())
KEYWORD_CONSTANTS = frozenset("true false null".split())
ASSIGNS = frozenset("= += -= *= /= .= %= **= ??= &= |= ^= <<= >>= ++ --".split())
EFFECTS = frozenset("eval exit die include include_once require require_once print throw".split())
REFLECTORS = frozenset("reflectionclass reflectionobject reflectionenum".split())
CLASS_NAME = re.compile(r"\\?[A-Za-z_\x80-\U0010FFFF][A-Za-z0-9_\x80-\U0010FFFF]*(?:\\[A-Za-z_\x80-\U0010FFFF][A-Za-z0-9_\x80-\U0010FFFF]*)*\Z")


class _Class:
    """A class being read; ``name`` is None for an anonymous one."""

    def __init__(self, kind: str, name: str | None, line: int):
        self.kind, self.name, self.line = kind, name, line
        self.flags: set[str] = set()
        self.extends: str | None = None
        self.implements: list[str] = []
        self.interface_extends: list[str] = []
        self.traits: list[str] = []
        self.dependencies: dict[str, None] = {}
        self.calls: dict[tuple[str, str], None] = {}
        self.superglobals: dict[str, None] = {}
        self.constructs: dict[str, None] = {}
        self.methods: list[dict] = []
        self.constants: list[dict] = []
        self.properties: list[dict] = []
        self.promoted: list[dict] = []
        #: first token of the declaration, and of each member: (kind, name, token)
        self.start = self.stop = 0
        self.spots: list[tuple[str, str, int]] = []


class FileFacts:
    """All facts of one file's tokens."""

    def __init__(self, tokens: list[Token]):
        self.t = tokens
        self.i = 0
        self.namespace = ""
        self.imports: dict[str, dict[str, str]] = {"class": {}, "function": {}, "const": {}}
        self.imported: list[str] = []
        self.classes: list[_Class] = []
        self.anonymous: list[_Class] = []
        self.open: list[_Class] = []
        self.method: list[dict | None] = []
        self.references: dict[str, None] = {}
        self.targets: dict[tuple[str | None, str], None] = {}
        self.functions: set[str] = set()
        self.declares = False
        self.effect: int | None = None
        self.depth = 0

    # -- tokens --

    def peek(self, k: int = 0) -> Token:
        at = self.i + k
        return self.t[at] if 0 <= at < len(self.t) else Token("end", "", self.t[-1].end if self.t else 1, 0)

    def next(self) -> Token:
        if self.i >= len(self.t):
            raise SyntaxProblem("the file ends too early")
        self.i += 1
        return self.t[self.i - 1]

    def at(self, *texts: str) -> bool:
        return self.i < len(self.t) and self.t[self.i].word in texts

    def take(self, *texts: str) -> bool:
        if self.i < len(self.t) and self.t[self.i].word in texts:
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> Token:
        if not self.at(text):
            raise SyntaxProblem(f"line {self.peek().line}: {text} was expected")
        return self.next()

    # -- names --

    def resolved(self, name: str, kind: str = "class") -> str | None:
        """The full name; None for an unqualified function or constant that only a run can resolve."""
        if name.startswith("\\"):
            return name[1:]
        if name.lower().startswith("namespace\\"):
            return f"{self.namespace}\\{name[10:]}".lstrip("\\")
        first, _, rest = name.partition("\\")
        if rest:
            base = self.imports["class"].get(first.lower())
            return f"{base}\\{rest}" if base else f"{self.namespace}\\{name}".lstrip("\\")
        own = self.imports[kind].get(first if kind == "const" else first.lower())
        if own:
            return own
        if kind != "class" and self.namespace:
            return None
        return f"{self.namespace}\\{name}".lstrip("\\")

    def uses(self, name: str | None) -> None:
        """A full name is used here: a dependency of the named classes around, or else of the file."""
        if not name or name.lower() in KEYWORD_CONSTANTS:
            return
        named = [c for c in self.open if c.name is not None]
        for c in named:
            c.dependencies.setdefault(name)
        if not named:
            self.references.setdefault(name)

    def class_name(self, token: Token) -> str | None:
        """A name where a class stands; None for self, static and parent."""
        if token.low() in ("self", "static", "parent"):
            return None
        name = self.resolved(token.text)
        self.uses(name)
        return name

    def note_string(self, text: str) -> None:
        if CLASS_NAME.match(text):
            text = text.removeprefix("\\")
            if text.lower() not in KEYWORD_CONSTANTS:
                self.references.setdefault(text)

    def branch(self) -> None:
        """Counts for the enclosing named method, also from closures and anonymous classes in it."""
        for m in reversed(self.method):
            if m is not None:
                m["cyclomatic_complexity"] += 1
                return

    # -- statements --

    def read(self) -> FileFacts:
        while self.peek().kind != "end":
            self.statement(top=True)
        return self

    def side_effect(self, line: int, top: bool) -> None:
        if top and (self.effect is None or line < self.effect):
            self.effect = line

    def statement(self, top: bool = False) -> None:
        token = self.peek()
        low = token.low() if token.kind == "name" else token.text
        if token.kind == "html":
            if token.text.strip():
                self.side_effect(token.line, top)
            self.i += 1
        elif token.kind == "open":
            self.i += 1
            if token.text == "<?=":
                self.side_effect(token.line, top)
                self.construct("echo")
                self.expression(top)
        elif token.kind == "attr":
            self.attribute()
        elif token.text == ";":
            self.i += 1
        elif token.text == "{":
            self.block(top)
        elif low == "namespace" and self.peek(1).text != "\\":
            self.i += 1
            self.namespace = self.next().text if self.peek().kind == "name" else ""
            self.imports, self.imported = {"class": {}, "function": {}, "const": {}}, []
            if self.at("{"):
                self.block(top)
            else:
                self.expect(";")
        elif low == "use" and not self.open:
            self.use()
        elif low == "const" and not self.open:
            self.declares |= top
            self.i += 1
            while not self.take(";"):
                self.next()
        elif low == "declare":
            self.i += 1
            self.parenthesised(top=False)
            self.take(";")
        elif low in ("abstract", "final", "readonly") and self.peek(1).low() in ("class", "abstract", "final", "readonly") or low in ("class", "interface", "trait") and self.peek(1).kind == "name" or low == "enum" and self.peek(1).kind == "name" and self.peek(1).low() not in ("extends", "implements"):
            self.declares |= top
            self.class_like()
        elif low == "function" and (self.peek(1).kind == "name" or self.peek(1).text == "&" and self.peek(2).kind == "name"):
            self.declares |= top
            self.i += 1
            self.take("&")
            name = self.next().text
            self.functions.add(f"{self.namespace}\\{name}".lstrip("\\").lower())
            self.function_rest(top_effects=False)
        elif low in ("if", "elseif", "while", "for", "foreach", "switch", "catch"):
            self.i += 1
            if low in BRANCHES:
                self.branch()
            self.parenthesised(top, types=low == "catch")
            self.body(top)
        elif low == "else" and self.peek(1).low() == "if":
            self.i += 1  # an if follows
        elif low in ("else", "try", "finally", "do"):
            self.i += 1
            if low == "do":
                self.branch()
            self.body(top)
            if low == "do" and self.take("while"):  # the end of the same loop
                self.parenthesised(top)
                self.take(";")
        elif low in ("case", "default") and self.peek(1).text not in ("=>", ","):
            self.i += 1
            self.branch()
            self.expression(top, stops=(":", ";"))
            self.take(":", ";")
        elif low in ("endif", "endwhile", "endfor", "endforeach", "endswitch", "enddeclare"):
            self.i += 1
            self.take(";")
        elif low in ("define", "\\define") and self.peek(1).text == "(":
            self.declares |= top
            self.expression(top=False)
        elif top and self._defines_on_condition():
            self.declares = True
            self.expression(top=False)
        else:
            if low not in ("return", "break", "continue", "goto"):
                self.side_effect(token.line, top)
            self.expression(top)

    def _defines_on_condition(self) -> bool:
        """``defined('X') || define('X', 1);``"""
        k = 1 if self.peek().text == "!" else 0
        if self.peek(k).low() not in ("defined", "\\defined", "define", "\\define") or self.peek(k + 1).text != "(":
            return False
        texts, j = [], 0
        while self.peek(j).text != ";" and self.peek(j).kind != "end":
            texts.append(self.peek(j).low())
            j += 1
        return any(x in ("||", "&&", "or", "and") for x in texts) and sum(x.lstrip("\\") == "define" for x in texts) == 1 and "=" not in texts

    def body(self, top: bool) -> None:
        """A statement, a block, or what stands between a colon and an end word."""
        if self.take(":", ";"):
            return
        if self.at("{"):
            self.block(top)
        elif self.peek().kind != "end":
            self.statement(top)

    def block(self, top: bool = False) -> int:
        """Statements in braces; returns the last one's line, 0 without any. The first's is told by the caller."""
        self.expect("{")
        last = 0
        while not self.at("}"):
            if self.peek().kind == "end":
                raise SyntaxProblem("a block isn't closed")
            self.statement(top)
            last = self.peek(-1).end
        self.i += 1
        return last

    def use(self) -> None:
        self.i += 1
        kind = "class"
        if self.at("function", "const") and self.peek(1).kind == "name":
            kind = self.next().low()

        def add(name: str, of: str) -> None:
            alias = name.rpartition("\\")[2]
            if self.take("as"):
                alias = self.next().text
            name = name.lstrip("\\")
            self.imports[of][alias if of == "const" else alias.lower()] = name
            self.imported.append(name)

        while True:
            name = self.next().text
            if self.at("\\") or name.endswith("\\"):
                self.take("\\")
                prefix = name.rstrip("\\")
                self.expect("{")
                while not self.take("}"):
                    of = kind
                    if self.at("function", "const") and self.peek(1).kind == "name":
                        of = self.next().low()
                    add(f"{prefix}\\{self.next().text}", of)
                    self.take(",")
            else:
                add(name, kind)
            if not self.take(","):
                break
        self.expect(";")

    # -- classes --

    def class_like(self) -> None:
        flags, start = set(), self.i
        while self.at("abstract", "final", "readonly"):
            flags.add(self.next().low())
        first = self.next()
        name = self.next()
        c = _Class(first.low(), f"{self.namespace}\\{name.text}".lstrip("\\"), first.line)
        c.flags = flags
        for i in self.imported:
            c.dependencies.setdefault(i)
        self.classes.append(c)
        self.open.append(c)
        self.class_rest(c)
        c.start, c.stop = start, self.i
        self.open.pop()

    def names(self) -> list[str]:
        out = []
        while True:
            token = self.next()
            if token.kind != "name":
                raise SyntaxProblem(f"line {token.line}: a name was expected")
            name = self.resolved(token.text)
            self.uses(name)
            out.append(name)
            if not self.take(","):
                return out

    def class_rest(self, c: _Class) -> None:
        if c.kind == "enum" and self.take(":"):
            self.type_until("{", "implements")
        if self.take("extends"):
            found = self.names()
            if c.kind == "interface":
                c.interface_extends = found
            else:
                c.extends = found[0]
        if self.take("implements"):
            c.implements = self.names()
        self.expect("{")
        while not self.take("}"):
            self.member(c)
        c.properties += c.promoted

    def member(self, c: _Class) -> None:
        token = self.peek()
        if token.kind == "end":
            raise SyntaxProblem("a class isn't closed")
        if token.kind == "attr":
            self.attribute()
            return
        if self.at("use"):
            self.i += 1
            found = self.names()
            if c.kind != "interface":
                c.traits += found
            if self.at("{"):
                depth = 0
                while True:
                    x = self.next()
                    depth += (x.text == "{") - (x.text == "}")
                    if x.kind == "name" and self.peek().text == "::":
                        self.class_name(x)
                    if not depth:
                        break
            else:
                self.expect(";")
            return
        if self.at("case") and c.kind == "enum":
            self.i += 2
            if self.take("="):
                self.expression()
            else:
                self.expect(";")
            return
        start, seen, spot = token.line, set(), self.i
        while self.at(*MODIFIERS):
            word = self.next().low()
            seen.add(word)
            if self.at("(") and word in ("public", "protected", "private"):  # private(set)
                self.i += 3
        visibility = next((v for v in ("private", "protected", "public") if v in seen), "public")
        explicit = bool(seen & {"private", "protected", "public"})
        if self.take("const"):
            if self.peek(1).text != "=":
                self.type_until_name()
            while True:
                name = self.next()
                c.spots.append(("constant", name.text, spot))
                c.constants.append({"name": name.text, "visibility": visibility, "has_explicit_visibility": explicit, "line": start})
                self.expect("=")
                self.expression(stops=(",", ";"))
                if not self.take(","):
                    break
            self.expect(";")
        elif self.take("function"):
            self.take("&")
            c.spots.append(("method", self.peek().text, spot))
            self.method_rest(c, self.next().text, start, visibility, explicit, "static" in seen)
        else:
            self.type_until_variable()
            while True:
                name = self.next()
                c.spots.append(("property", name.text[1:], spot))
                c.properties.append({"name": name.text[1:], "visibility": visibility, "has_explicit_visibility": explicit, "line": start})
                if self.take("="):
                    self.expression(stops=(",", ";", "{"))
                if self.at("{"):
                    self.hooks()
                    return
                if not self.take(","):
                    break
            self.expect(";")

    def hooks(self) -> None:
        self.expect("{")
        while not self.take("}"):
            while self.at("final", "&"):
                self.i += 1
            self.next()
            if self.at("("):
                self.parameters(None)
            if self.take("=>"):
                self.expression()
            elif self.at("{"):
                self.block()
            else:
                self.take(";")

    def method_rest(self, c: _Class, name: str, line: int, visibility: str, explicit: bool, static: bool) -> None:
        m = {"name": name, "visibility": visibility, "has_return_type": False, "is_static": static, "param_count": 0, "cyclomatic_complexity": 1, "line_count": 0,
             "has_explicit_visibility": explicit, "line": line, "is_magic": name.lower() in MAGIC}
        c.methods.append(m)
        self.method.append(m if c.name is not None else None)
        m["param_count"] = self.parameters(c)
        if self.take(":"):
            m["has_return_type"] = True
            self.type_until("{", ";")
        if not self.take(";"):
            first = self.peek(1)
            last = self.block()
            m["line_count"] = last - first.line + 1 if last else 0
        self.method.pop()

    def parameters(self, c: _Class | None) -> int:
        self.expect("(")
        n = 0
        while not self.take(")"):
            seen, line = set(), self.peek().line
            while self.peek().kind == "attr":
                self.attribute()
            spot = self.i
            while self.at("public", "protected", "private", "readonly", "final"):
                seen.add(self.next().low())
                if self.at("(") and self.peek(1).low() == "set":
                    self.i += 3
            self.type_until_variable()
            name = self.next()
            n += 1
            if seen and c is not None:
                visibility = next((v for v in ("private", "protected", "public") if v in seen), "public")
                c.spots.append(("property", name.text[1:], spot))
                c.promoted.append({"name": name.text[1:], "visibility": visibility, "has_explicit_visibility": bool(seen & {"private", "protected", "public"}), "line": line})
            if self.take("="):
                self.expression(stops=(",", ")"))
            if self.at("{"):
                self.hooks()
            self.take(",")
        return n

    def type_token(self, token: Token) -> None:
        if token.kind == "name" and token.low() not in BUILTIN_TYPES:
            self.uses(self.resolved(token.text))

    def type_until(self, *stops: str) -> None:
        while not self.at(*stops):
            self.type_token(self.next())

    def type_until_variable(self) -> None:
        while self.peek().kind != "var":
            if self.at(";", "{", "}"):
                raise SyntaxProblem(f"line {self.peek().line}: a variable was expected")
            self.type_token(self.next())

    def type_until_name(self) -> None:
        while not (self.peek().kind == "name" and self.peek(1).text == "="):
            self.type_token(self.next())

    def function_rest(self, top_effects: bool, arrow: bool = False) -> None:
        """Parameters, closed-over variables, return type and body."""
        self.parameters(None)
        if self.at("use"):
            self.i += 1
            self.parenthesised(False)
        if self.take(":"):
            self.type_until("=>" if arrow else "{")
        if arrow:
            self.expect("=>")
        else:
            self.block()

    # -- expressions --

    def attribute(self) -> None:
        self.expect("#[")
        depth = 1
        while depth:
            token = self.next()
            depth += (token.text in ("[", "#[")) - (token.text == "]")
            if token.kind == "name" and depth == 1 and self.peek(-2).text in ("#[", ","):
                self.class_name(token)
            elif token.kind == "name" and self.peek().text == "::":
                self.class_name(token)
            elif token.kind == "string":
                self.note_string(token.text)
            elif token.kind == "name" and token.low() == "new":
                self.instantiation()

    def parenthesised(self, top: bool, types: bool = False) -> None:
        self.expect("(")
        while not self.at(")"):
            if types and self.peek().kind == "name":
                self.class_name(self.next())
            else:
                self.piece(top)
        self.i += 1

    def expression(self, top: bool = False, stops: tuple[str, ...] = (";",)) -> None:
        """Tokens up to a stop at the same depth, which is taken only if it is a semicolon by default."""
        while not (self.at(*stops) or self.at(")", "]", "}")):
            if self.peek().kind == "end":
                if stops == (";",) and not self.open:
                    return
                raise SyntaxProblem("an expression isn't closed")
            self.piece(top)
        if stops == (";",):
            self.take(";")

    def construct(self, name: str) -> None:
        for c in self.open:
            if c.name is not None:
                c.constructs.setdefault(CONSTRUCTS[name])

    def piece(self, top: bool) -> None:
        """One token of an expression, or a bracketed part, closure, class or call."""
        token = self.next()
        text, low = token.text, token.low()
        if token.kind == "op" or token.kind == "attr":
            if text == "#[":
                self.i -= 1
                self.attribute()
            elif text in ("(", "[", "{"):
                close = {"(": ")", "[": "]", "{": "}"}[text]
                while not self.at(close):
                    self.piece(top)
                self.i += 1
            elif text in ("&&", "||") or text == "?" and self.peek().text != ">":
                self.branch()
            elif text in (")", "]", "}"):
                raise SyntaxProblem(f"line {token.line}: {text} closes nothing")
            if text in ASSIGNS:
                self.side_effect(token.line, top)
            return
        if token.kind == "string":
            self.note_string(text)
        elif token.kind == "shell":
            self.side_effect(token.line, top)
        elif token.kind == "var":
            if text in SUPERGLOBALS:
                for c in self.open:
                    if c.name is not None:
                        c.superglobals.setdefault(text)
        elif token.kind == "open":
            self.construct("echo")
        elif token.kind == "name":
            self.word(token, low, top)

    def word(self, token: Token, low: str, top: bool) -> None:
        before, after = self.peek(-2).text, self.peek().text
        if before in ("->", "?->", "::"):
            if before != "::" and low.startswith(("newinstance", "newlazy")):
                self.reflection(self.i - 1)
            return
        if low == "new":
            self.instantiation()
        elif low == "function" or low == "fn" and after in ("(", "&"):
            self.take("&")
            self.function_rest(top_effects=False, arrow=low == "fn")
        elif low == "match" and after == "(":
            self.parenthesised(top)
            self.match(top)
        elif low in ("and", "or"):
            self.branch()
        elif low in CONSTRUCTS and after != "::" and not (low == "list" and after != "("):
            self.construct(low)
            if low in EFFECTS:
                self.side_effect(token.line, top)
        elif low == "throw":
            self.side_effect(token.line, top)
        elif low == "instanceof":
            if self.peek().kind == "name":
                self.class_name(self.next())
        elif after == "::":
            self.class_name(token)
        elif low == "static" and after in ("function", "fn") or low in RESERVED:
            return
        elif after == "(":
            name = self.resolved(token.text, "function")
            self.uses(name)
            for c in self.open:
                if c.name is not None:
                    c.calls.setdefault((name or "", token.text if name is None else ""))
        elif after == ":" and before in ("(", ","):
            return  # a named argument
        else:
            self.uses(self.resolved(token.text, "const"))

    def match(self, top: bool) -> None:
        self.expect("{")
        while not self.take("}"):
            self.branch()
            if not self.take("default"):
                while not self.at("=>"):
                    self.piece(top)
            else:
                self.take(",")
            self.expect("=>")
            while not self.at(",", "}"):
                self.piece(top)
            self.take(",")

    def instantiation(self) -> None:
        while self.peek().kind == "attr":
            self.attribute()
        if self.at("class", "readonly") and not (self.at("readonly") and self.peek(1).low() != "class"):
            line = self.next().line
            self.take("class")
            if self.at("("):
                self.parenthesised(False)
            c = _Class("class", None, line)
            self.anonymous.append(c)
            self.open.append(c)
            self.method.append(None)
            self.class_rest(c)
            self.method.pop()
            self.open.pop()
        elif self.peek().kind == "name":
            token = self.next()
            if token.low() in ("self", "static", "parent"):
                self.target(token.low())
            else:
                name = self.class_name(token)
                self.targets.setdefault((None, name))
        elif self.at("("):
            start = self.i
            value, end = self.constant(start + 1)
            if value is not None and end < len(self.t) and self.t[end].text == ")":
                self.targets.setdefault(value)

    def constant(self, i: int) -> tuple[tuple[str | None, str] | None, int]:
        """A constant class name: text, X::class, or such joined by dots."""
        parts: list[str] = []
        while True:
            token = self.t[i] if i < len(self.t) else Token("end", "", 0, 0)
            if token.kind == "string":
                parts.append(token.text)
                i += 1
            elif token.kind == "name" and i + 2 < len(self.t) and self.t[i + 1].text == "::" and self.t[i + 2].low() == "class":
                if token.low() in ("self", "static", "parent"):
                    return self.keyword(token.low()), i + 3
                parts.append(self.resolved(token.text) or "")
                i += 3
            else:
                return None, i
            if i < len(self.t) and self.t[i].text == ".":
                i += 1
                continue
            name = "".join(parts).removeprefix("\\")
            return ((None, name) if CLASS_NAME.match(name) else None), i

    def keyword(self, word: str) -> tuple[str | None, str] | None:
        """What self, static or parent is in the innermost class, as far as its own clauses tell."""
        if not self.open:
            return None
        c = self.open[-1]
        if c.name is None:
            if word == "parent":
                return (None, c.extends) if c.extends else None
            return None
        if c.kind == "trait":
            return word, c.name
        if word == "parent":
            return (None, c.extends) if c.extends else None
        return (None, c.name) if word == "self" else ("static", c.name)

    def target(self, word: str) -> None:
        if (found := self.keyword(word)) is not None:
            self.targets.setdefault(found)

    def reflection(self, at: int) -> None:
        """``(new ReflectionClass(X))->newInstance...``: X is created."""
        i = at - 2
        if i < 0 or self.t[i].text != ")":
            return
        depth = 0
        while i >= 0:
            depth += (self.t[i].text == ")") - (self.t[i].text == "(")
            if not depth:
                break
            i -= 1
        if i + 3 < len(self.t) and self.t[i + 1].low() == "new" and (self.resolved(self.t[i + 2].text) or "").lower() in REFLECTORS and self.t[i + 3].text == "(":
            value, _ = self.constant(i + 4)
            if value is not None:
                self.targets.setdefault(value)


TAG = re.compile(r"<\?(?!=)(?:(php|xml-stylesheet|xml)(?![A-Za-z0-9_-]))?", re.I)


def invalid_tag_line(source: str) -> int | None:
    """The line of the first tag other than ``<?php`` and ``<?=``."""
    try:
        return _tag_line(tokenize(source))
    except SyntaxProblem:
        return None


def _tag_line(tokens: list[Token]) -> int | None:
    for token in tokens:
        if token.kind == "open" and token.text not in ("<?php", "<?="):
            return token.line
        if token.kind == "html":
            for m in TAG.finditer(token.text):
                if not m[1]:
                    return token.line + token.text.count("\n", 0, m.start())
    return None


def facts_of(file: str, content: bytes) -> dict[str, list[dict]]:
    """Rows of each table for one file; a file with broken syntax has no classes."""
    out: dict[str, list[dict]] = {name: [] for name in TABLES}
    source = content.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode()
    analysis = {"file": file, "invalid_php_tag_line": None, "has_valid_ast": True, "declares_symbols": False, "has_side_effects": False, "side_effect_line": 1}
    out["analyses"].append(analysis)
    try:
        tokens = tokenize(source)
        analysis["invalid_php_tag_line"] = _tag_line(tokens)
        f = FileFacts(tokens).read()
    except (SyntaxProblem, IndexError, RecursionError):
        analysis["has_valid_ast"] = False
        return out
    analysis |= {"declares_symbols": f.declares, "has_side_effects": f.effect is not None, "side_effect_line": f.effect or 1}
    for c in f.classes:
        calls = [full or (own if own.lower() in f.functions else written) for full, written in c.calls for own in [f"{c.name.rpartition(chr(92))[0]}\\{written}".lstrip("\\")]]
        out["nodes"].append({
            "class_name": c.name, "file": file, "line": c.line, "layer": None, "layers": [], "extends": c.extends, "is_abstract": c.kind == "class" and "abstract" in c.flags,
            "is_final": c.kind == "class" and "final" in c.flags, "is_interface": c.kind == "interface", "is_readonly": c.kind == "class" and "readonly" in c.flags, "is_trait": c.kind == "trait", "is_enum": c.kind == "enum",
            "dependencies": list(c.dependencies), "implements": c.implements, "interface_extends": c.interface_extends, "traits": c.traits, "methods": c.methods, "constants": c.constants,
            "properties": c.properties, "function_calls": list(dict.fromkeys(calls)), "superglobals": list(c.superglobals), "language_constructs": list(c.constructs)})
    out["anonymous"] = [{"file": file, "line": c.line, "extends": c.extends, "implements": c.implements, "traits": c.traits} for c in f.anonymous]
    if f.references:
        out["references"].append({"file": file, "references": list(f.references)})
    if f.targets:
        out["instantiations"].append({"file": file, "targets": [{"keyword": k, "class_name": n} for k, n in f.targets]})
    return out


#: Bytes of source whose facts are handed on together.
LOT_BYTES = 8 << 20
#: What the extractor knows of a file; the rest of ``schemas.FILE_ANALYSES`` Spark tells from its bytes.
_ANALYSES = "file string, invalid_php_tag_line int, has_valid_ast boolean, declares_symbols boolean, has_side_effects boolean, side_effect_line int"


def extract(files: DataFrame, *, materialise: bool = True, only: Collection[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    """The fact tables of ``files`` (file, content), all or ``only`` some. Files are dealt to all cores, as a few bytes
    of source are much work, and parsed in one pass, whose result is written to the checkpoint folder as all tables
    read it; without ``materialise`` each table parses on its own."""
    spark = files.sparkSession
    ddl = {name: _ANALYSES if name == "analyses" else schema for name, schema in TABLES.items() if name in only}
    fields = ", ".join([*(f"{name} array<struct<{', '.join(_field(x) for x in _fields(schema))}>>" for name, schema in ddl.items()), "bom boolean, utf8 boolean"])
    arrow = to_arrow_schema(_parse_datatype_string(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # handed on in lots, as facts take several times their sources' room
            rows, size = [], 0
            for file, content, bom, utf8 in zip(*batch.columns, strict=True):
                source = content.as_py() or b""
                rows.append(facts_of(file.as_py(), source) | {"bom": bom.as_py(), "utf8": utf8.as_py()})
                size += len(source)
                if size >= LOT_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    dealt = files.select("file", "content").repartition(parts, "file")
    parsed = dealt.select("file", "content", has_bom("content").alias("bom"), is_utf8("content").alias("utf8")).mapInArrow(run, fields)
    parsed = cut(parsed) if materialise else parsed
    out = {name: parsed.select(F.inline(name)) for name in ddl if name != "analyses"}
    if "analyses" in ddl:
        names = [p.split()[0] for p in schemas.FILE_ANALYSES.split(", ")]
        out["analyses"] = parsed.select(F.col("bom").alias("has_utf8_bom"), F.col("utf8").alias("has_valid_utf8"), F.inline("analyses")).select(*names)
    return out


def _field(ddl: str) -> str:
    name, _, kind = ddl.partition(" ")
    return f"{name}: {kind}"
