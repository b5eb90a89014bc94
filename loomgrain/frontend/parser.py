"""A syntax tree of JavaScript and TypeScript files, as far as the analyses look at it."""

from __future__ import annotations

from loomgrain.frontend.scanner import Scanner, Token

# Fixed values of the language: binary operators by how tightly they bind.
_LEVELS = (("??",), ("||",), ("&&",), ("|",), ("^",), ("&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">=", "instanceof", "in", "as", "satisfies"), ("<<", ">>", ">>>"), ("+", "-"), ("*", "/", "%"), ("**",))
BINDING = {op: i + 1 for i, level in enumerate(_LEVELS) for op in level}
ASSIGNING = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
MODIFIERS = frozenset("public private protected static abstract override readonly declare async accessor".split())
FUNCTIONS = frozenset("FunctionDeclaration MethodDeclaration ArrowFunction FunctionExpression Constructor GetAccessor SetAccessor".split())


class SyntaxTrouble(Exception):
    pass


class Node:
    __slots__ = ("kind", "start", "end", "kids", "parent", "a")

    def __init__(self, kind: str, start: int, end: int = 0, kids: list[Node] = (), **a):
        self.kind, self.start, self.end, self.kids, self.parent, self.a = kind, start, end, [k for k in kids if k is not None], None, a

    def __getattr__(self, name: str):
        try:
            return self.a[name]
        except KeyError:
            return None

    def walk(self):
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(reversed(n.kids))


class Parser:
    """Recursive descent with trials where the grammar needs a look ahead (arrows, type arguments)."""

    def __init__(self, source: str, markup: bool = True):
        self.scan, self.source, self.markup = Scanner(source), source, markup
        self.last, self.no_in = 0, False
        self.failed: set[tuple[int, str]] = set()
        self.t = self.scan.next(0)

    # tokens
    def advance(self) -> Token:
        t = self.t
        self.last = t.end
        self.t = self.scan.next(t.end)
        return t

    def at(self, *texts: str) -> bool:
        return self.t.text in texts and self.t.kind in ("word", "sign")

    def eat(self, text: str) -> bool:
        if self.at(text):
            self.advance()
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.at(text):
            raise SyntaxTrouble(f"{text} expected at {self.t.start}, not {self.t.text!r}")
        return self.advance()

    def peek(self) -> Token:
        return self.scan.next(self.t.end)

    def trial(self, label: str, f):
        """``f()``, or None and the place as before if it doesn't parse."""
        here = (self.t, self.last)
        if (here[0].start, label) in self.failed:
            return None
        try:
            out = f()
        except SyntaxTrouble:
            out = None
        if out is None:
            self.t, self.last = here
            self.failed.add((here[0].start, label))
        return out

    def end_statement(self) -> None:
        if not self.eat(";") and not (self.t.newline or self.t.kind == "end" or self.at("}")):
            raise SyntaxTrouble(f"end of statement expected at {self.t.start}")

    def done(self, kind: str, start: int, kids=(), **a) -> Node:
        return Node(kind, start, self.last, kids, **a)

    def name(self) -> Node:
        if self.t.kind not in ("word", "private"):
            raise SyntaxTrouble(f"a name expected at {self.t.start}")
        t = self.advance()
        return Node("Identifier", t.start, t.end, text=t.text)

    # types
    def type(self) -> Node:
        start, kids = self.t.start, []
        self.type_union(kids)
        if self.at("extends") and not self.t.newline and not self.no_conditional:
            self.advance()
            hold, self.no_conditional = self.no_conditional, True
            self.type_union(kids)
            self.no_conditional = hold
            if self.eat("?"):
                kids.append(self.type())
                self.need(":")
                kids.append(self.type())
        return self.done("Type", start, kids)

    no_conditional = False

    def type_union(self, kids: list) -> None:
        if self.at("|", "&"):
            self.advance()
        while True:
            self.type_primary(kids)
            if not self.at("|", "&"):
                return
            self.advance()

    def type_primary(self, kids: list) -> None:
        t = self.t
        if t.kind == "word" and t.text in ("keyof", "readonly", "unique", "infer", "asserts", "abstract") and self.peek().kind in ("word", "sign") and self.peek().text not in ("|", "&", ">", ",", ")", ";", "=", "]", "}", ".", "[", ":", "?", "is"):
            self.advance()
            return self.type_primary(kids)
        if t.text == "typeof" and t.kind == "word":
            self.advance()
            if self.at("import"):
                return self.type_primary(kids)
            kids.append(self.expression_name())
            if self.at("<") and not self.t.newline:
                kids += self.type_arguments()
        elif t.text == "new" and t.kind == "word":
            self.advance()
            return self.type_primary(kids)
        elif t.text == "import" and t.kind == "word":
            self.advance()
            self.need("(")
            kids.append(self.type())
            self.need(")")
            while self.eat("."):
                self.name()
            if self.at("<"):
                kids += self.type_arguments()
        elif t.kind == "word":
            if t.text == "this" or self.peek().text != "is" or self.peek().newline:
                pass
            n = self.advance()
            kids.append(Node("TypeReference", n.start, n.end, text=n.text))
            while self.at(".") or self.at("?."):
                self.advance()
                self.name()
            if self.at("<") and not self.t.newline:
                kids += self.type_arguments()
            if self.at("is") and not self.t.newline:
                self.advance()
                kids.append(Node("IsPredicate", n.start, n.end, [self.type()], subject=n.text))
        elif t.kind in ("string", "number"):
            self.advance()
        elif t.text == "-":
            self.advance()
            self.advance()
        elif t.kind == "template":
            kids.append(self.template_literal(types=True))
        elif t.text == "{":
            kids.append(self.type_members())
        elif t.text == "[":
            self.advance()
            while not self.at("]"):
                self.eat("...")
                if self.t.kind == "word" and self.peek().text in (":", "?"):
                    p = self.peek()
                    if p.text == ":" or self.scan.next(p.end).text == ":":
                        self.advance()
                        self.eat("?")
                        self.need(":")
                kids.append(self.type())
                self.eat("?")
                if not self.eat(","):
                    break
            self.need("]")
        elif t.text in ("(", "<"):
            made = self.trial("function type", self.function_type)
            if made is not None:
                kids.append(made)
                return None
            self.need("(")
            hold, self.no_conditional = self.no_conditional, False
            kids.append(self.type())
            self.no_conditional = hold
            self.need(")")
        else:
            raise SyntaxTrouble(f"a type expected at {t.start}")
        while self.at("[") and not self.t.newline:
            self.advance()
            if not self.at("]"):
                kids.append(self.type())
            self.need("]")
        return None

    def expression_name(self) -> Node:
        n = self.advance()
        out = Node("Identifier", n.start, n.end, text=n.text)
        while self.eat("."):
            self.name()
        return out

    def function_type(self) -> Node:
        start = self.t.start
        kids = self.type_parameters() if self.at("<") else []
        kids += self.parameters()
        self.need("=>")
        kids.append(self.type())
        return self.done("FunctionType", start, kids)

    def close_angle(self) -> None:
        if not self.t.text.startswith(">") or self.t.kind != "sign":
            raise SyntaxTrouble(f"> expected at {self.t.start}")
        self.last = self.t.start + 1
        self.t = self.scan.next(self.t.start + 1) if len(self.t.text) > 1 else self.scan.next(self.t.end)

    def type_arguments(self) -> list[Node]:
        self.need("<")
        hold, self.no_conditional = self.no_conditional, False
        out = []
        while not self.t.text.startswith(">"):
            out.append(self.type())
            if not self.eat(","):
                break
        self.no_conditional = hold
        self.close_angle()
        return out

    def type_parameters(self) -> list[Node]:
        self.need("<")
        out = []
        while not self.t.text.startswith(">"):
            start = self.t.start
            while self.at("const", "in", "out") and self.peek().kind == "word":
                self.advance()
            self.name()
            kids = []
            hold, self.no_conditional = self.no_conditional, False
            if self.eat("extends"):
                kids.append(self.type())
            if self.eat("="):
                kids.append(self.type())
            self.no_conditional = hold
            out.append(self.done("TypeParameter", start, kids))
            if not self.eat(","):
                break
        self.close_angle()
        return out

    def type_members(self) -> Node:
        """The braces of an interface or a type literal: members with their kind, name, mark and text of the rest."""
        start = self.need("{").start
        hold, self.no_conditional = self.no_conditional, False
        members = []
        while not self.at("}"):
            s = self.t.start
            while self.t.text in ("readonly", "-", "+", "get", "set") and self.peek().text not in (":", "?", "(", ";", ",", "}", "<"):
                self.advance()
            kids, label, kind = [], None, "prop"
            if self.at("[", ):
                self.advance()
                if self.t.kind == "word" and self.peek().text in (":", "in"):
                    self.advance()
                    self.advance()
                    kids.append(self.type())
                    if self.eat("as"):
                        kids.append(self.type())
                    kind = "index"
                else:
                    kids.append(self.assignment())
                self.need("]")
                label = self.source[s : self.last]
            elif self.at("(", "<"):
                kind = "call"
            elif self.at("new") and self.peek().text in ("(", "<"):
                self.advance()
                kind = "call"
            else:
                if self.t.kind not in ("word", "string", "number", "private"):
                    raise SyntaxTrouble(f"a member expected at {self.t.start}")
                label = self.advance().text
            if self.at("-", "+"):
                self.advance()
            optional = self.eat("?")
            rest = self.t.start
            if self.at("(", "<"):
                kind = "method" if kind == "prop" else kind
                if self.at("<"):
                    kids += self.type_parameters()
                kids += self.parameters()
            if self.eat(":"):
                if kind == "prop":
                    rest = self.t.start
                kids.append(self.type())
            members.append(self.done("TypeMember", s, kids, member=kind, text=label, optional=optional, rest=self.source[rest : self.last]))
            if not (self.eat(";") or self.eat(",")) and not self.t.newline and not self.at("}"):
                raise SyntaxTrouble(f"; expected at {self.t.start}")
        self.need("}")
        self.no_conditional = hold
        return self.done("TypeLiteral", start, members)

    # functions
    def parameters(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.at(")"):
            start = self.t.start
            kids = self.decorators()
            while self.t.text in ("public", "private", "protected", "readonly", "override") and self.peek().kind in ("word",) or self.t.text in ("public", "private", "protected", "readonly") and self.peek().text in ("{", "["):
                self.advance()
            rest = self.eat("...")
            target = self.binding()
            optional = self.eat("?")
            typed = self.type() if self.eat(":") else None
            init = self.assignment() if self.eat("=") else None
            out.append(self.done("Parameter", start, [*kids, target, typed, init], target=target, rest=rest, init=init, optional=optional))
            if not self.eat(","):
                break
        self.need(")")
        return out

    def binding(self) -> Node:
        start = self.t.start
        if self.at("{", "["):
            close = "}" if self.advance().text == "{" else "]"
            parts = []
            while not self.at(close):
                if self.eat(","):
                    continue
                s = self.t.start
                rest = self.eat("...")
                key = None
                if close == "}" and not rest:
                    if self.at("["):
                        self.advance()
                        key = self.assignment()
                        self.need("]")
                        self.need(":")
                    elif self.peek().text == ":":
                        self.advance()
                        self.advance()
                target = self.binding()
                init = self.assignment() if self.eat("=") else None
                parts.append(self.done("BindingElement", s, [key, target, init], target=target, rest=rest))
                if not self.at(close):
                    self.need(",")
            self.need(close)
            return self.done("ObjectBindingPattern" if close == "}" else "ArrayBindingPattern", start, parts)
        return self.name()

    def decorators(self) -> list[Node]:
        out = []
        while self.at("@"):
            start = self.advance().start
            out.append(self.done("Decorator", start, [self.call_chain(self.primary())]))
        return out

    def return_type(self) -> Node | None:
        if not self.eat(":"):
            return None
        return self.type()

    def function_rest(self, kind: str, start: int, kids: list, **a) -> Node:
        tp = self.type_parameters() if self.at("<") else []
        params = self.parameters()
        ret = self.return_type()
        body = self.block() if self.at("{") else None
        return self.done(kind, start, [*kids, *tp, *params, ret, body], params=params, body=body, ret=ret, generic=bool(tp), **a)

    def function(self, start: int, is_async: bool, declaration: bool) -> Node:
        self.need("function")
        star = self.eat("*")
        name = self.name() if self.t.kind == "word" and not self.at("(") else None
        f = self.function_rest("FunctionDeclaration" if declaration else "FunctionExpression", start, [name], name=name, is_async=is_async, star=star)
        if declaration and f.body is None:
            self.end_statement()
        return f

    def arrow(self) -> Node:
        start = self.t.start
        is_async = self.at("async") and not self.peek().newline and self.peek().text in ("(", "<") or self.at("async") and self.peek().kind == "word" and not self.peek().newline
        if is_async:
            self.advance()
        tp = self.type_parameters() if self.at("<") else []
        if self.t.kind == "word":
            n = self.name()
            params = [Node("Parameter", n.start, n.end, [n], target=n)]
            ret = None
        else:
            params = self.parameters()
            ret = self.return_type()
        if not self.at("=>") or self.t.newline:
            raise SyntaxTrouble("no arrow")
        self.advance()
        hold, self.no_in = self.no_in, self.no_in
        body = self.block() if self.at("{") else self.assignment()
        self.no_in = hold
        return self.done("ArrowFunction", start, [*tp, *params, ret, body], params=params, body=body, ret=ret, generic=bool(tp), is_async=is_async)

    # expressions
    def expression(self) -> Node:
        start, first = self.t.start, self.assignment()
        if not self.at(","):
            return first
        parts = [first]
        while self.eat(","):
            parts.append(self.assignment())
        return self.done("CommaExpression", start, parts)

    def assignment(self) -> Node:
        t = self.t
        if t.kind == "word" and self.peek().text == "=>" or t.text == "(" and t.kind == "sign" or t.text == "<" and t.kind == "sign" or t.text == "async" and t.kind == "word" and (self.peek().text in ("(", "<") or self.peek().kind == "word") and not self.peek().newline and self.peek().text != "function":
            made = self.trial("arrow", self.arrow)
            if made is not None:
                return made
        if t.text == "yield" and t.kind == "word":
            start = self.advance().start
            self.eat("*")
            value = None if self.t.newline or self.at(")", "]", "}", ",", ";", ":") or self.t.kind == "end" else self.assignment()
            return self.done("YieldExpression", start, [value])
        left = self.conditional()
        if self.t.text in ASSIGNING and self.t.kind == "sign":
            op = self.advance().text
            return self.done("BinaryExpression", left.start, [left, self.assignment()], op=op)
        return left

    def conditional(self) -> Node:
        test = self.binary(0)
        if not self.at("?"):
            return test
        self.advance()
        hold, self.no_in = self.no_in, False
        yes = self.assignment()
        self.no_in = hold
        self.need(":")
        return self.done("ConditionalExpression", test.start, [test, yes, self.assignment()])

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            op = self.t.text if self.t.kind in ("sign", "word") else ""
            level = BINDING.get(op, 0)
            if level <= least or op == "in" and self.no_in or op in ("as", "satisfies") and self.t.newline:
                return left
            self.advance()
            if op in ("as", "satisfies"):
                made = None if self.eat("const") else self.type()
                left = self.done("AsExpression" if op == "as" else "SatisfiesExpression", left.start, [left, made], inner=left)
            else:
                left = self.done("BinaryExpression", left.start, [left, self.binary(level - (op == "**"))], op=op)

    def unary(self) -> Node:
        t = self.t
        if t.kind == "sign" and t.text in ("!", "~", "+", "-", "++", "--") or t.kind == "word" and t.text in ("typeof", "void", "delete"):
            self.advance()
            kind = {"typeof": "TypeOfExpression", "void": "VoidExpression", "delete": "DeleteExpression"}.get(t.text, "PrefixUnaryExpression")
            return self.done(kind, t.start, [self.unary()], op=t.text)
        if t.kind == "word" and t.text == "await" and self.peek().text not in (")", ",", ";", "=", ".", "]", "}", ":", "=>"):
            self.advance()
            return self.done("AwaitExpression", t.start, [self.unary()])
        if t.text == "<" and t.kind == "sign" and not self.markup:
            self.advance()
            made = self.type() if not self.eat("const") else None
            self.close_angle()
            inner = self.unary()
            return self.done("TypeAssertion", t.start, [made, inner], inner=inner)
        e = self.call_chain(self.primary())
        if self.at("++", "--") and not self.t.newline:
            self.advance()
            return self.done("PostfixUnaryExpression", e.start, [e])
        return e

    def arguments(self) -> list[Node]:
        self.need("(")
        hold, self.no_in = self.no_in, False
        out = []
        while not self.at(")"):
            start = self.t.start
            if self.eat("..."):
                out.append(self.done("SpreadElement", start, [self.assignment()]))
            else:
                out.append(self.assignment())
            if not self.eat(","):
                break
        self.no_in = hold
        self.need(")")
        return out

    def call_chain(self, e: Node, calls: bool = True) -> Node:
        while True:
            if self.at(".") or self.at("?."):
                self.advance()
                if self.at("("):
                    args = self.arguments()
                    e = self.done("CallExpression", e.start, [e, *args], callee=e, args=args)
                elif self.at("["):
                    self.advance()
                    i = self.expression()
                    self.need("]")
                    e = self.done("ElementAccessExpression", e.start, [e, i], left=e)
                else:
                    n = self.name()
                    e = self.done("PropertyAccessExpression", e.start, [e, Node("PropertyName", n.start, n.end, text=n.text)], left=e, text=n.text)
            elif self.at("["):
                self.advance()
                hold, self.no_in = self.no_in, False
                i = self.expression()
                self.no_in = hold
                self.need("]")
                e = self.done("ElementAccessExpression", e.start, [e, i], left=e)
            elif self.at("(") and calls:
                args = self.arguments()
                e = self.done("CallExpression", e.start, [e, *args], callee=e, args=args)
            elif self.at("!") and not self.t.newline and self.peek().text not in ("=", "=="):
                self.advance()
                e = self.done("NonNullExpression", e.start, [e], inner=e)
            elif self.t.kind == "template":
                e = self.done("TaggedTemplateExpression", e.start, [e, self.template_literal()])
            elif self.at("<") and calls:
                made = self.trial("call types", self.typed_call_tail)
                if made is None:
                    return e
                types, args = made
                e = self.done("CallExpression", e.start, [e, *types, *args], callee=e, args=args)
            else:
                return e

    def typed_call_tail(self) -> tuple[list[Node], list[Node]]:
        types = self.type_arguments()
        if not self.at("("):
            raise SyntaxTrouble("no call")
        return types, self.arguments()

    def template_literal(self, types: bool = False) -> Node:
        t, kids = self.t, []
        piece = t
        while piece.text.endswith("${") and piece.kind == "template":
            self.last, self.t = piece.end, self.scan.next(piece.end)
            kids.append(self.type() if types else self.expression())
            if not self.at("}"):
                raise SyntaxTrouble("template")
            piece = self.scan.template(self.t.start)
        self.last, self.t = piece.end, self.scan.next(piece.end)
        return self.done("TemplateExpression" if kids else "NoSubstitutionTemplateLiteral", t.start, kids)

    def primary(self) -> Node:
        t = self.t
        if t.kind == "sign" and t.text in ("/", "/="):
            self.t = t = self.scan.next(t.start, regex=True)
            if t.kind == "regex":
                self.advance()
                return self.done("RegularExpressionLiteral", t.start)
            raise SyntaxTrouble("regex")
        if t.kind in ("string", "number"):
            self.advance()
            return self.done("StringLiteral" if t.kind == "string" else "NumericLiteral", t.start, text=t.text)
        if t.kind == "template":
            return self.template_literal()
        if t.kind == "private":
            return self.name()
        if t.kind == "word":
            if t.text == "function":
                return self.function(t.start, False, False)
            if t.text == "async" and self.peek().text == "function" and not self.peek().newline:
                self.advance()
                return self.function(t.start, True, False)
            if t.text == "class":
                return self.class_(t.start, [], "ClassExpression")
            if t.text == "new":
                self.advance()
                if self.eat("."):
                    self.name()
                    return self.done("MetaProperty", t.start)
                callee = self.call_chain(self.primary(), calls=False)
                types = self.trial("new types", self.type_arguments) if self.at("<") else None
                args = self.arguments() if self.at("(") else []
                return self.done("NewExpression", t.start, [callee, *(types or []), *args], callee=callee, args=args)
            self.advance()
            if t.text in ("this", "super", "null", "true", "false", "import"):
                if t.text == "import" and self.eat("."):
                    self.name()
                    return self.done("MetaProperty", t.start)
                return self.done({"this": "ThisKeyword", "super": "SuperKeyword", "null": "NullKeyword", "true": "TrueKeyword", "false": "FalseKeyword", "import": "ImportKeyword"}[t.text], t.start)
            return self.done("Identifier", t.start, text=t.text)
        if t.text == "(":
            self.advance()
            hold, self.no_in = self.no_in, False
            e = self.expression()
            self.no_in = hold
            self.need(")")
            return self.done("ParenthesizedExpression", t.start, [e], inner=e)
        if t.text == "[":
            self.advance()
            kids = []
            hold, self.no_in = self.no_in, False
            while not self.at("]"):
                if self.eat(","):
                    continue
                s = self.t.start
                kids.append(self.done("SpreadElement", s, [self.assignment()]) if self.eat("...") else self.assignment())
                if not self.at("]"):
                    self.need(",")
            self.no_in = hold
            self.need("]")
            return self.done("ArrayLiteralExpression", t.start, kids)
        if t.text == "{":
            return self.object_literal()
        if t.text == "@":
            d = self.decorators()
            return self.class_(self.t.start, d, "ClassExpression")
        if t.text == "<" and self.markup:
            return self.jsx()
        raise SyntaxTrouble(f"an expression expected at {t.start}, not {t.text!r}")

    def property_name(self) -> tuple[str | None, Node | None]:
        if self.at("["):
            s = self.advance().start
            e = self.assignment()
            self.need("]")
            return self.source[s : self.last], e
        if self.t.kind in ("word", "string", "number", "private"):
            return self.advance().text, None
        raise SyntaxTrouble(f"a property expected at {self.t.start}")

    def object_literal(self) -> Node:
        start = self.need("{").start
        hold, self.no_in = self.no_in, False
        kids = []
        while not self.at("}"):
            s = self.t.start
            if self.eat("..."):
                kids.append(self.done("SpreadAssignment", s, [self.assignment()]))
            else:
                kids.append(self.object_member(s))
            if not self.at("}"):
                self.need(",")
        self.no_in = hold
        self.need("}")
        return self.done("ObjectLiteralExpression", start, kids)

    def object_member(self, s: int) -> Node:
        ahead = self.peek()
        plain = ahead.text in (",", ":", "(", "}", "=", "<") and ahead.kind == "sign"
        is_async = accessor = star = False
        if self.at("async") and not plain:
            self.advance()
            is_async = True
        elif self.at("get", "set") and not plain:
            accessor = self.advance().text
        star = self.eat("*")
        at = self.t.start
        label, computed = self.property_name()
        anchor = Node("PropertyName", at, self.last, [computed], text=label)
        if accessor:
            return self.function_rest("GetAccessor" if accessor == "get" else "SetAccessor", s, [anchor], name=anchor)
        if self.at("(", "<"):
            return self.function_rest("MethodDeclaration", s, [anchor], name=anchor, is_async=is_async, star=star)
        if self.eat(":"):
            value = self.assignment()
            return self.done("PropertyAssignment", s, [anchor, value], name=anchor, init=value)
        use = Node("Identifier", at, self.last, text=label)
        init = self.assignment() if self.eat("=") else None
        return self.done("ShorthandPropertyAssignment", s, [use, init])

    # markup
    def jsx(self) -> Node:
        """An element or fragment; the scanner isn't used for its text."""
        start, src = self.t.start, self.source
        node, end = self.jsx_at(start)
        self.last, self.t = end, self.scan.next(end)
        node.start, node.end = start, end
        del src
        return node

    def jsx_tag(self, at: int) -> tuple[str, Node | None, int]:
        import re

        m = re.compile(r"\s*([A-Za-z_$][\w$:.-]*)").match(self.source, at)
        if not m:
            return "", None, at
        root = m[1].split(".")[0]
        use = Node("Identifier", m.start(1), m.start(1) + len(root), text=root) if m[1][0].isupper() or "." in m[1] or m[1][0] in "_$" else None
        return m[1], use, m.end()

    def jsx_expression(self, at: int) -> tuple[Node | None, int, bool]:
        """What is between braces from ``at`` (after the opening one): (expression, place after the closing one, spread)."""
        hold = (self.t, self.last, self.no_in)
        self.t, self.no_in = self.scan.next(at), False
        spread = self.eat("...")
        e = None if self.at("}") else self.expression()
        if not self.at("}"):
            raise SyntaxTrouble(f"}} expected at {self.t.start}")
        end = self.t.end
        self.t, self.last, self.no_in = hold
        return e, end, spread

    def jsx_at(self, at: int) -> tuple[Node, int]:
        start, src, skip = at, self.source, self.scan.skip
        tag, use, at = self.jsx_tag(skip(at + 1))
        attrs: list[Node] = []
        while True:
            at = skip(at)
            if src.startswith("/>", at):
                return Node("JsxSelfClosingElement", start, at + 2, [use, *attrs], tag=tag, attrs=attrs), at + 2
            if src.startswith(">", at):
                at += 1
                break
            if src.startswith("{", at):
                e, end, _ = self.jsx_expression(at + 1)
                attrs.append(Node("JsxSpreadAttribute", at, end, [e], inner=e))
                at = end
                continue
            name, _, end = self.jsx_tag(at)
            if not name:
                raise SyntaxTrouble(f"an attribute expected at {at}")
            value, s = None, at
            at = skip(end)
            if src.startswith("=", at):
                at = skip(at + 1)
                if src.startswith("{", at):
                    value, at, _ = self.jsx_expression(at + 1)
                elif src.startswith("<", at):
                    value, at = self.jsx_at(at)
                else:
                    q = src[at : at + 1]
                    close = src.find(q, at + 1) if q in "'\"" and q else -1
                    if close < 0:
                        raise SyntaxTrouble("attribute")
                    value, at = Node("StringLiteral", at, close + 1, text=src[at : close + 1]), close + 1
            attrs.append(Node("JsxAttribute", s, at, [value], text=name))
        children: list[Node] = []
        while True:
            stop = min((i for i in (src.find("<", at), src.find("{", at)) if i >= 0), default=-1)
            if stop < 0:
                raise SyntaxTrouble("element without end")
            if stop > at:
                children.append(Node("JsxText", at, stop, text=src[at:stop]))
            if src[stop] == "{":
                e, at, _ = self.jsx_expression(stop + 1)
                children.append(Node("JsxExpression", stop, at, [e]))
            elif src.startswith("</", skip(stop)):
                close = src.find(">", stop)
                if close < 0:
                    raise SyntaxTrouble("element without end")
                return Node("JsxElement" if tag else "JsxFragment", start, close + 1, [use, *attrs, *children], tag=tag, attrs=attrs, children=children), close + 1
            else:
                child, at = self.jsx_at(stop)
                children.append(child)

    # classes
    def class_(self, start: int, decorators: list, kind: str) -> Node:
        self.need("class")
        name = self.name() if self.t.kind == "word" and not self.at("extends", "implements") else None
        kids = [*decorators, name]
        if self.at("<"):
            kids += self.type_parameters()
        extends = implements = False
        if self.eat("extends"):
            extends = True
            kids.append(self.call_chain(self.primary()))
            if self.at("<"):
                kids += self.type_arguments()
        if self.eat("implements"):
            implements = True
            kids.append(self.type())
            while self.eat(","):
                kids.append(self.type())
        self.need("{")
        members = []
        while not self.at("}"):
            if not self.eat(";"):
                members.append(self.class_member())
        self.need("}")
        return self.done(kind, start, [*kids, *members], name=name, members=members, extends=extends, implements=implements, decorated=bool(decorators) or any(m.decorated for m in members))

    def class_member(self) -> Node:
        s, decorators, mods = self.t.start, self.decorators(), set()
        while self.t.kind == "word" and self.t.text in MODIFIERS:
            ahead = self.peek()
            if ahead.text in ("(", "=", ";", ":", "?", "!", "}", "<") and ahead.kind == "sign" or ahead.newline and self.t.text in ("async", "accessor"):
                break
            mods.add(self.advance().text)
            if "static" in mods and self.at("{"):
                return self.done("ClassStaticBlock", s, [self.block()])
        a = {"decorated": bool(decorators), "override": "override" in mods, "is_async": "async" in mods, "static": "static" in mods}
        accessor = None
        if self.at("get", "set") and not (self.peek().text in ("(", "=", ";", ":", "?", "!", "}", "<") and self.peek().kind == "sign"):
            accessor = self.advance().text
        star = self.eat("*")
        if self.at("[") and (inner := self.peek()).kind == "word" and self.scan.next(inner.end).text == ":":
            self.advance()
            self.name()
            self.need(":")
            kids = [self.type()]
            self.need("]")
            kids.append(self.return_type())
            self.end_statement()
            return self.done("IndexSignature", s, kids)
        at = self.t.start
        label, computed = self.property_name()
        anchor = Node("PropertyName", at, self.last, [computed], text=label)
        if not self.eat("?"):
            self.eat("!")
        if self.at("(", "<"):
            kind = "Constructor" if label == "constructor" and not a["static"] else "GetAccessor" if accessor == "get" else "SetAccessor" if accessor == "set" else "MethodDeclaration"
            f = self.function_rest(kind, s, [*decorators, anchor], name=anchor, star=star, **a)
            if f.body is None:
                self.end_statement()
            return f
        typed = self.type() if self.eat(":") else None
        init = self.assignment() if self.eat("=") else None
        self.end_statement()
        return self.done("PropertyDeclaration", s, [*decorators, anchor, typed, init], name=anchor, init=init, typed=typed, **a)

    # statements
    def block(self) -> Node:
        start = self.need("{").start
        hold, self.no_in = self.no_in, False
        kids = []
        while not self.at("}"):
            if self.t.kind == "end":
                raise SyntaxTrouble("block without end")
            kids.append(self.statement())
        self.no_in = hold
        self.need("}")
        return self.done("Block", start, kids)

    def program(self) -> Node:
        kids = []
        while self.t.kind != "end":
            here = self.t.start
            try:
                kids.append(self.statement())
            except (SyntaxTrouble, RecursionError):
                self.recover(here)
                kids.append(Node("Unparsed", here, self.last))
        root = Node("SourceFile", 0, len(self.source), kids)
        stack = [root]
        while stack:
            n = stack.pop()
            for k in n.kids:
                k.parent = n
                stack.append(k)
        return root

    def recover(self, start: int) -> None:
        """Go on at the next line that begins a statement."""
        import re

        m = re.compile(r"\n(?=(?:export|import|function|class|interface|type|const|let|var|enum|async|declare|abstract)\b)").search(self.source, max(start, 0) + 1)
        self.last = m.end() if m else len(self.source)
        self.no_in = self.no_conditional = False
        self.t = self.scan.next(self.last)

    def statement(self) -> Node:
        t, start = self.t, self.t.start
        word = t.text if t.kind == "word" else ""
        if t.text == "{" and t.kind == "sign":
            return self.block()
        if t.text == ";" and t.kind == "sign":
            self.advance()
            return self.done("EmptyStatement", start)
        if t.text == "@":
            d = self.decorators()
            if self.at("export"):
                return self.export(start, d)
            self.eat("abstract")
            return self.class_(start, d, "ClassDeclaration")
        ahead = self.peek()
        f = getattr(self, f"s_{word}", None) if word else None
        if f is not None and not (word in ("type", "interface", "namespace", "module", "declare", "abstract", "enum", "let", "async", "global") and not self.declares(word, ahead)):
            if not (word == "import" and ahead.text in ("(", ".")):
                return f(start)
        if t.kind == "word" and ahead.text == ":" and ahead.kind == "sign":
            self.advance()
            self.advance()
            return self.done("LabeledStatement", start, [self.statement()])
        e = self.expression()
        self.end_statement()
        return self.done("ExpressionStatement", start, [e])

    def declares(self, word: str, ahead: Token) -> bool:
        if word == "async":
            return ahead.text == "function" and not ahead.newline
        if word == "let":
            return ahead.kind == "word" or ahead.text in ("{", "[")
        if word == "global":
            return ahead.text == "{"
        return (ahead.kind == "word" or ahead.kind == "string" and word in ("module", "namespace")) and not ahead.newline and ahead.text not in ("in", "instanceof", "as", "of")

    def s_import(self, start: int) -> Node:
        self.advance()
        if self.t.kind == "string":
            spec = self.advance().text
            self.import_attributes()
            self.end_statement()
            return self.done("ImportDeclaration", start, spec=spec[1:-1], names=[], side_effect=True)
        if self.at("type") and self.peek().text not in ("from", ",", "="):
            self.advance()
        names = []
        if self.t.kind == "word" and not (self.at("from") and self.peek().kind == "string"):
            local = self.name()
            if self.eat("="):
                e = self.assignment()
                self.end_statement()
                return self.done("ImportEquals", start, [e])
            names.append(("default", "default", local.text, local.start))
            self.eat(",")
        if self.eat("*"):
            self.need("as")
            n = self.name()
            names.append(("namespace", "*", n.text, n.start))
        elif self.at("{"):
            names += [("named", o, l, p) for o, l, p in self.specifiers()]
        self.need("from")
        spec = self.advance().text
        self.import_attributes()
        self.end_statement()
        return self.done("ImportDeclaration", start, spec=spec[1:-1], names=names, side_effect=False)

    def import_attributes(self) -> None:
        if self.at("with", "assert") and self.peek().text == "{":
            self.advance()
            self.object_literal()

    def specifiers(self) -> list[tuple[str, str, int]]:
        self.need("{")
        out = []
        while not self.at("}"):
            if self.at("type") and self.peek().text not in (",", "}", "as"):
                self.advance()
            at = self.t.start
            first = self.advance().text.strip("'\"")
            second = self.advance().text.strip("'\"") if self.eat("as") else first
            out.append((first, second, at))
            if not self.eat(","):
                break
        self.need("}")
        return out

    def s_export(self, start: int) -> Node:
        return self.export(start, [])

    def export(self, start: int, decorators: list) -> Node:
        self.need("export")
        if self.at("type") and self.peek().text in ("{", "*"):
            self.advance()
        if self.eat("*"):
            alias = self.advance().text if self.eat("as") else None
            self.need("from")
            spec = self.advance().text[1:-1]
            self.import_attributes()
            self.end_statement()
            return self.done("ExportDeclaration", start, spec=spec, star=True, alias=alias, names=[])
        if self.at("{"):
            names = self.specifiers()
            spec = self.advance().text[1:-1] if self.eat("from") else None
            self.import_attributes()
            self.end_statement()
            return self.done("ExportDeclaration", start, spec=spec, star=False, names=names)
        if self.eat("="):
            e = self.expression()
            self.end_statement()
            return self.done("ExportAssignment", start, [e])
        if self.eat("default"):
            decorators = decorators + self.decorators()
            here = self.t.start
            if self.at("function") or self.at("async") and self.peek().text == "function":
                is_async = self.eat("async")
                n = self.function(here, is_async, True)
            elif self.at("class") or self.at("abstract") and self.peek().text == "class":
                self.eat("abstract")
                n = self.class_(here, decorators, "ClassDeclaration")
            elif self.at("interface") and self.peek().kind == "word":
                n = self.s_interface(here)
            else:
                e = self.assignment()
                self.end_statement()
                return self.done("ExportAssignment", start, [e], default=True)
            n.a |= {"exported": True, "is_default": True}
            n.start = start
            return n
        if self.at("import"):
            return self.s_import(start)
        if decorators or self.at("@"):
            decorators = decorators + self.decorators()
            self.eat("abstract")
            n = self.class_(start, decorators, "ClassDeclaration")
        else:
            n = self.statement()
        n.a["exported"] = True
        n.start = start
        return n

    def s_declare(self, start: int) -> Node:
        self.advance()
        n = self.statement()
        n.start = start
        n.a["ambient"] = True
        return n

    def s_abstract(self, start: int) -> Node:
        self.advance()
        return self.class_(start, [], "ClassDeclaration")

    def s_class(self, start: int) -> Node:
        return self.class_(start, [], "ClassDeclaration")

    def s_function(self, start: int) -> Node:
        return self.function(start, False, True)

    def s_async(self, start: int) -> Node:
        self.advance()
        return self.function(start, True, True)

    def s_interface(self, start: int) -> Node:
        self.advance()
        name, kids = self.name(), []
        if self.at("<"):
            kids += self.type_parameters()
        if self.eat("extends"):
            kids.append(self.type())
            while self.eat(","):
                kids.append(self.type())
        body = self.type_members()
        return self.done("InterfaceDeclaration", start, [name, *kids, body], name=name, body=body)

    def s_type(self, start: int) -> Node:
        self.advance()
        name = self.name()
        kids = self.type_parameters() if self.at("<") else []
        self.need("=")
        value = self.type()
        self.end_statement()
        literal = value.kids[0] if len(value.kids) == 1 and value.kids[0].kind == "TypeLiteral" and value.kids[0].start == value.start and value.kids[0].end == value.end else None
        return self.done("TypeAliasDeclaration", start, [name, *kids, value], name=name, body=literal)

    def s_enum(self, start: int) -> Node:
        self.advance()
        name = self.name()
        self.need("{")
        kids = []
        while not self.at("}"):
            s = self.t.start
            self.property_name()
            kids.append(self.done("EnumMember", s, [self.assignment() if self.eat("=") else None]))
            if not self.eat(","):
                break
        self.need("}")
        return self.done("EnumDeclaration", start, [name, *kids], name=name)

    def s_namespace(self, start: int) -> Node:
        self.advance()
        name = None
        if self.t.kind == "string":
            self.advance()
        else:
            name = self.name()
            while self.eat("."):
                self.name()
        body = self.block() if self.at("{") else None
        if body is None:
            self.end_statement()
        return self.done("ModuleDeclaration", start, [name, body], name=name)

    s_module = s_namespace

    def s_global(self, start: int) -> Node:
        self.advance()
        return self.done("ModuleDeclaration", start, [self.block()])

    def variables(self, start: int) -> list[Node]:
        out = []
        while True:
            s = self.t.start
            target = self.binding()
            self.eat("!")
            typed = self.type() if self.eat(":") else None
            init = self.assignment() if self.eat("=") else None
            out.append(self.done("VariableDeclaration", s, [target, typed, init], target=target, typed=typed, init=init))
            if not self.eat(","):
                return out

    def s_var(self, start: int) -> Node:
        if self.advance().text == "const" and self.at("enum"):
            return self.s_enum(start)
        decls = self.variables(start)
        self.end_statement()
        return self.done("VariableStatement", start, decls, decls=decls)

    s_let = s_const = s_var

    def s_return(self, start: int) -> Node:
        word = self.advance().text
        e = None if self.t.newline or self.at(";", "}") or self.t.kind == "end" else self.expression()
        self.end_statement()
        return self.done("ReturnStatement" if word == "return" else "ThrowStatement", start, [e], value=e)

    s_throw = s_return

    def s_break(self, start: int) -> Node:
        word = self.advance().text
        if self.t.kind == "word" and not self.t.newline:
            self.advance()
        self.end_statement()
        return self.done(word.title() + "Statement", start)

    s_continue = s_debugger = s_break

    def condition(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def s_if(self, start: int) -> Node:
        self.advance()
        test, yes = self.condition(), self.statement()
        return self.done("IfStatement", start, [test, yes, self.statement() if self.eat("else") else None])

    def s_while(self, start: int) -> Node:
        self.advance()
        return self.done("WhileStatement", start, [self.condition(), self.statement()])

    s_with = s_while

    def s_do(self, start: int) -> Node:
        self.advance()
        body = self.statement()
        self.need("while")
        test = self.condition()
        self.eat(";")
        return self.done("DoStatement", start, [body, test])

    def s_for(self, start: int) -> Node:
        self.advance()
        wait = self.eat("await")
        self.need("(")
        kids, self.no_in = [], True
        if self.at("var", "let", "const"):
            s = self.advance().start
            decls = self.variables(s)
            kids.append(self.done("VariableDeclarationList", s, decls))
        elif not self.at(";"):
            kids.append(self.expression())
        self.no_in = False
        if self.at("of", "in"):
            kind = "ForOfStatement" if self.advance().text == "of" else "ForInStatement"
            kids.append(self.expression())
        else:
            kind = "ForStatement"
            self.need(";")
            if not self.at(";"):
                kids.append(self.expression())
            self.need(";")
            if not self.at(")"):
                kids.append(self.expression())
        self.need(")")
        kids.append(self.statement())
        return self.done(kind, start, kids, wait=wait)

    def s_switch(self, start: int) -> Node:
        self.advance()
        kids = [self.condition()]
        self.need("{")
        while not self.at("}"):
            s = self.t.start
            parts = []
            if self.eat("default"):
                kind = "DefaultClause"
            else:
                self.need("case")
                parts.append(self.expression())
                kind = "CaseClause"
            self.need(":")
            while not self.at("case", "default", "}"):
                parts.append(self.statement())
            kids.append(self.done(kind, s, parts))
        self.need("}")
        return self.done("SwitchStatement", start, kids)

    def s_try(self, start: int) -> Node:
        self.advance()
        kids = [self.block()]
        if self.at("catch"):
            s = self.advance().start
            param = typed = None
            if self.eat("("):
                param = self.binding()
                typed = self.type() if self.eat(":") else None
                self.need(")")
            body = self.block()
            kids.append(self.done("CatchClause", s, [param, typed, body], param=param, body=body))
        if self.eat("finally"):
            kids.append(self.block())
        return self.done("TryStatement", start, kids)


def parse(source: str, path: str = "x.tsx") -> Node:
    """The tree of a file; a statement that doesn't parse is one ``Unparsed`` node and the rest goes on."""
    return Parser(source, markup=not path.endswith(".ts")).program()
