"""Source files to rows: each file is parsed once, in a worker, and only rows leave it.

One wide record table holds everything; the functions below it give the narrow tables. A file that does not
parse gives one `error` record instead of ending the job.
"""

from __future__ import annotations

import ast
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = "module string, path string, record string, ord int, kind string, name string, target string, level int, flag boolean, names array<struct<name:string,alias:string>>, scope array<string>, contexts array<string>"
_FIELDS = ["module", "path", "record", "ord", "kind", "name", "target", "level", "flag", "names", "scope", "contexts"]
_PAIRS = pa.list_(pa.struct([("name", pa.string()), ("alias", pa.string())]))
_SCHEMA = pa.schema([(f, pa.int32() if f in ("ord", "level") else pa.bool_() if f == "flag" else _PAIRS if f == "names" else pa.list_(pa.string()) if f in ("scope", "contexts") else pa.string()) for f in _FIELDS])
#: Modules whose import alone does something that must not move; so does any name that begins with an underscore.
IMPORT_EFFECTS = (
    "antigravity", "this", "__hello__", "__phello__", "site", "sitecustomize", "usercustomize", "readline", "rlcompleter", "turtle", "tkinter", "webbrowser",
    "platform", "locale", "os", "sys", "logging", "warnings", "encodings", "pygame", "matplotlib",
)
#: Names whose subscripts are type hints and not read at run time.
TYPE_HINTS = (
    "List", "Dict", "Set", "Tuple", "list", "dict", "set", "tuple", "Optional", "Union", "Callable", "Type", "Any", "TypeVar", "Generic", "Literal", "Final",
    "ClassVar", "Annotated", "Self",
)
_BLOCKS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try, ast.TryStar, ast.Match)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST) -> str | None:
    """a.b.c of an attribute chain on a name."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def string_list(node: ast.AST) -> list[str] | None:
    """The strings of a list or tuple literal; None if it is anything else or holds anything else."""
    if isinstance(node, (ast.List, ast.Tuple)) and all(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in node.elts):
        return [x.value for x in node.elts]
    return None


def target_names(node: ast.AST) -> list[str]:
    """Names that an assignment target binds, distinct and in order of the alphabet."""
    return sorted({x.id for x in ast.walk(node) if isinstance(x, ast.Name) and isinstance(x.ctx, (ast.Store, ast.Del))})


def reads(*nodes: ast.AST | None) -> list[str]:
    """Names that expressions read, in order of their first place."""
    found = [x.id for n in nodes if n is not None for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)]
    return list(dict.fromkeys(found))


def attributes(*nodes: ast.AST | None) -> list[tuple[str, str]]:
    """(base, attribute) of accesses on a dotted name."""
    found = [(b, x.attr) for n in nodes if n is not None for x in ast.walk(n) if isinstance(x, ast.Attribute) and (b := dotted(x.value))]
    return list(dict.fromkeys(found))


def impure(node: ast.AST | None) -> bool:
    """Whether evaluating an expression may do something: calls, subscripts, awaits, yields, lambdas' bodies aside, attributes of other than names."""
    if node is None or isinstance(node, (ast.Constant, ast.Name)):
        return False
    if isinstance(node, (ast.Call, ast.Subscript, ast.Await, ast.Yield, ast.YieldFrom, ast.NamedExpr)):
        return True
    if isinstance(node, ast.Lambda):
        return True
    if isinstance(node, ast.Attribute):
        return dotted(node) is None
    return any(impure(x) for x in ast.iter_child_nodes(node) if isinstance(x, (ast.expr, ast.comprehension)))


def module_impure(tree: ast.Module, stdlib: frozenset[str]) -> bool:
    """Whether importing the module does more than bind names. In doubt it does."""
    imported = {(a.asname or a.name).split(".")[0] for s in tree.body if isinstance(s, (ast.Import, ast.ImportFrom)) for a in s.names}

    def of(statement: ast.stmt) -> bool:
        match statement:
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                return any(impure(d) for d in statement.decorator_list)
            case ast.Import():
                return any(a.name.split(".")[0] not in stdlib for a in statement.names)
            case ast.ImportFrom():
                root = (statement.module or "").split(".")[0]
                return any(a.name == "*" for a in statement.names) if statement.level and not root else not statement.level and root not in stdlib and root != "__future__"
            case ast.Assign() | ast.AnnAssign() | ast.AugAssign():
                targets = statement.targets if isinstance(statement, ast.Assign) else [statement.target]
                if all(isinstance(t, ast.Name) and t.id == "__all__" for t in targets):
                    return False
                plain = all(isinstance(t, (ast.Name, ast.Tuple, ast.List)) for t in targets)
                return not plain or impure(statement.value) or bool(imported & set(reads(statement.value)) and isinstance(statement.value, ast.Call))
            case ast.Expr(value=ast.Constant()) | ast.Pass() | ast.TypeAlias():
                return False
            case ast.If(test=test) if type_checking(test) is not None:
                return any(of(s) for s in statement.orelse)
            case ast.Expr(value=ast.Call(func=ast.Attribute(value=ast.Name(id="__all__")))):
                return False
        return True

    return any(of(s) for s in tree.body)


def type_checking(test: ast.expr) -> bool | None:
    """True if a test is TYPE_CHECKING, False if it is its negation, else None."""
    if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
        inner = type_checking(test.operand)
        return None if inner is None else not inner
    return True if dotted(test) in ("TYPE_CHECKING", "typing.TYPE_CHECKING") else None


def future_imports(tree: ast.Module) -> list[str]:
    """Absolute __future__ names at the head of a module; a docstring may come first, any other statement ends them."""
    found: list[str] = []
    for i, s in enumerate(tree.body):
        if isinstance(s, ast.ImportFrom) and s.module == "__future__" and not s.level:
            found += [a.name for a in s.names]
        elif not (i == 0 and isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant)):
            break
    return found


_SCOPES = (*_DEFS, ast.ClassDef, ast.Lambda)


def own_nodes(body: list[ast.AST]) -> Iterator[ast.AST]:
    """All nodes of a scope in order of their place: of inner definitions themselves and what they evaluate at once, not their bodies."""
    for node in body:
        yield node
        if isinstance(node, _SCOPES):
            inner = [x for field, value in ast.iter_fields(node) if field != "body" for x in (value if isinstance(value, list) else [value])]
            yield from own_nodes([x for x in inner if isinstance(x, ast.AST)])
        else:
            yield from own_nodes(list(ast.iter_child_nodes(node)))


def _body(scope: ast.AST) -> list[ast.AST]:
    return scope.body if isinstance(scope.body, list) else [scope.body]


def _declared(scope: ast.AST) -> set[str]:
    return {n for x in own_nodes(_body(scope)) if isinstance(x, ast.Global) for n in x.names}


def local_names(scope: ast.AST) -> set[str]:
    """Names that a function, class or lambda binds itself: parameters, targets, imports, inner definitions, handlers' and patterns' names; not its globals."""
    found = {p.arg for p in ast.walk(scope.args) if isinstance(p, ast.arg)} if hasattr(scope, "args") else set()
    for x in own_nodes(_body(scope)):
        match x:
            case ast.Name(ctx=ast.Store()):
                found.add(x.id)
            case ast.Import() | ast.ImportFrom():
                found |= {a.asname or a.name.split(".")[0] for a in x.names if a.name != "*"}
            case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                found.add(x.name)
            case ast.ExceptHandler(name=str()) | ast.MatchAs(name=str()) | ast.MatchStar(name=str()):
                found.add(x.name)
            case ast.MatchMapping(rest=str()):
                found.add(x.rest)
            case ast.Nonlocal():
                found |= set(x.names)
    return found - _declared(scope)


def free_reads(scope: ast.AST) -> list[str]:
    """Names that a scope's body reads and neither it nor the inner scope that reads them binds, in order."""
    own, out = local_names(scope), []
    for x in own_nodes(_body(scope)):
        if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load):
            out.append(x.id)
        elif isinstance(x, _SCOPES):
            out += free_reads(x)
    return [n for n in out if n not in own]


def global_writes(scope: ast.AST) -> set[str]:
    """Globals that a scope or an inner one declares and binds or deletes."""
    declared, out = _declared(scope), set()
    for x in own_nodes(_body(scope)):
        if isinstance(x, ast.Name) and isinstance(x.ctx, (ast.Store, ast.Del)) and x.id in declared:
            out.add(x.id)
        elif isinstance(x, _SCOPES):
            out |= global_writes(x)
    return out


def _typing(node: ast.expr) -> bool:
    """Whether an attribute chain's base is typing, typing_extensions or collections.abc."""
    name = dotted(node) or ""
    return name.split(".")[0] in ("typing", "typing_extensions") or name == "collections.abc"


def used_symbols(body: list[ast.AST]) -> list[str]:
    """Names that a body uses at run time, in order: annotations, type aliases and parameters, subscripts of type hints and the type of a cast aside."""
    out: list[str] = []

    def visit(node: ast.AST) -> None:
        match node:
            case ast.TypeAlias():
                return
            case ast.Name():
                out.append(node.id)
                return
            case ast.Subscript(value=ast.Name(id=name)) if name in TYPE_HINTS:
                return visit(node.value)
            case ast.Subscript(value=ast.Attribute(attr=attr, value=base)) if attr in TYPE_HINTS or _typing(base):
                return visit(node.value)
            case ast.Call(func=ast.Name(id="cast")) | ast.Call(func=ast.Attribute(attr="cast")) if isinstance(node.func, ast.Name) or _typing(node.func.value):
                for x in (node.func, *node.args[1:], *(k.value for k in node.keywords)):
                    visit(x)
                return
        for field, value in ast.iter_fields(node):
            if field not in ("annotation", "returns", "type_params"):
                for x in value if isinstance(value, list) else [value]:
                    if isinstance(x, ast.AST):
                        visit(x)

    for s in body:
        visit(s)
    return list(dict.fromkeys(out))


class Reader:
    """Collects the records of one module."""

    def __init__(self, module: str, path: str, source: str, stdlib: frozenset[str]):
        self.module, self.path, self.stdlib, self.rows = module, path, stdlib, []
        self.items = self.imports = 0
        self.importlib: dict[str, str] = {}
        tree = ast.parse(source)
        self.emit("module", kind="docstring", name=ast.get_docstring(tree, clean=False), flag=module_impure(tree, stdlib))
        for i, name in enumerate(future_imports(tree)):
            self.emit("future", ord=i, name=name)
        self.discover(tree.body, [], [])
        self.block(tree.body, None)
        self.symbols(tree.body, "module")
        self.usages(tree.body, "module")
        self.exports(tree)
        self.globals(tree)
        for n, node in enumerate(ast.walk(tree)):
            self.last = n
        self.emit("nodes", ord=self.last + 1)

    def emit(self, record: str, **values: object) -> None:
        self.rows.append({"module": self.module, "path": self.path, "record": record} | values)

    # Imports: where they stand and how they are reached.

    def discover(self, body: list[ast.stmt], scope: list[str], contexts: list[str]) -> None:
        for s in body:
            inner = contexts
            if isinstance(s, ast.Import):
                for a in s.names:
                    if a.name == "importlib" or a.name.startswith("importlib."):
                        self.importlib[a.asname or "importlib"] = "importlib"
                    self.imported("Direct", a.name, [(a.name, a.asname)], 0, scope, contexts)
            elif isinstance(s, ast.ImportFrom):
                if s.module == "importlib":
                    self.importlib |= {(a.asname or a.name): "import_module" for a in s.names if a.name == "import_module"}
                self.imported("Relative" if s.level else "From", s.module or "", [(a.name, a.asname) for a in s.names], s.level, scope, contexts)
            elif isinstance(s, _DEFS):
                kind = "Method" if scope and scope[-1].startswith("Class:") else "Function"
                where = "ClassInit" if kind == "Method" and s.name == "__init__" else "FunctionBody"
                self.discover(s.body, [*scope, f"{kind}:{s.name}"], [*contexts, where])
            elif isinstance(s, ast.ClassDef):
                self.discover(s.body, [*scope, f"Class:{s.name}"], [*contexts, "ClassBody"])
            elif isinstance(s, _BLOCKS):
                name = type(s).__name__.removeprefix("Async").removesuffix("Star")
                if isinstance(s, ast.If):
                    side = type_checking(s.test)
                    self.discover(s.body, [*scope, name], [*inner, "TypeChecking"] if side else inner)
                    self.discover(s.orelse, [*scope, name], [*inner, "TypeChecking"] if side is False else inner)
                else:
                    for part in _bodies(s):
                        self.discover(part, [*scope, name], inner)
            own = [s] if not isinstance(s, (*_BLOCKS, *_DEFS, ast.ClassDef)) else []
            for node in own:
                self.literal_imports(node, scope, contexts)

    def literal_imports(self, node: ast.AST, scope: list[str], contexts: list[str]) -> None:
        """importlib.import_module("literal") is an import too; a second literal is the package of a relative name."""
        for call in ast.walk(node):
            if not isinstance(call, ast.Call) or not call.args or not isinstance(call.args[0], ast.Constant) or not isinstance(call.args[0].value, str):
                continue
            name = dotted(call.func) or ""
            head, _, tail = name.rpartition(".")
            if self.importlib.get(name) == "import_module" or self.importlib.get(head) == "importlib" and tail == "import_module":
                text = call.args[0].value
                level = len(text) - len(text.lstrip("."))
                package = call.args[1].value if len(call.args) > 1 and isinstance(call.args[1], ast.Constant) else None
                self.imported("ImportlibStatic", text.lstrip("."), [], level, scope, contexts, package)

    def imported(self, kind: str, name: str, names: list, level: int, scope: list[str], contexts: list[str], package: str | None = None) -> None:
        checking = "TypeChecking" in contexts
        movable = not any(c in ("ClassBody", "ClassInit") for c in contexts) and bool(contexts) and name not in IMPORT_EFFECTS and not name.startswith("_")
        self.emit("import", ord=self.imports, kind=kind, name=name, target=package, level=level, flag=movable, names=[{"name": a, "alias": b} for a, b in names], scope=scope, contexts=["TypeChecking"] * checking + [c for c in contexts if c != "TypeChecking"] or ["ModuleLevel"])
        self.imports += 1

    # Items: statements with what they bind, read and write.

    def item(self, kind: str, scope: str | None, name: str | None = None, target: str | None = None, level: int = 0, star: bool = False, effects: bool = False, roles: dict[str, list[str]] | None = None, deps: list[tuple[str, str]] = (), attrs: list[tuple[str, str]] = ()) -> None:
        n = self.items
        self.items += 1
        self.emit("item", ord=n, kind=kind, name=name, target=target, level=level, flag=effects, scope=[scope] if scope else None, contexts=["star"] if star else None)
        for role, found in (roles or {}).items():
            for x in dict.fromkeys(found):
                self.emit("name", ord=n, kind=role, name=x)
        for symbol, dep in dict.fromkeys(deps):
            self.emit("dep", ord=n, name=symbol, target=dep)
        for base, attr in dict.fromkeys(attrs):
            self.emit("attr", ord=n, name=base, target=attr)

    def block(self, body: list[ast.stmt], scope: str | None) -> None:
        for s in body:
            self.statement(s, scope)

    def statement(self, s: ast.stmt, scope: str | None) -> None:
        match s:
            case ast.Import():
                for a in s.names:
                    own = a.asname or a.name.split(".")[0]
                    self.item("Import", scope, own, a.name, effects=a.name.split(".")[0] not in self.stdlib, roles={"decl": [own], "imported": [own]})
                    self.emit("binding", ord=self.items - 1, kind="module", name=own, target=a.name if a.asname else a.name.split(".")[0], level=0)
            case ast.ImportFrom() if s.module != "__future__":
                star = any(a.name == "*" for a in s.names)
                own = [a.asname or a.name for a in s.names if a.name != "*"]
                root = (s.module or "").split(".")[0]
                effects = star if s.level and not root else root not in self.stdlib
                self.item("FromImport", scope, None, s.module or "", s.level, star, effects, {"decl": own, "imported": own, "reexported": [a.name for a in s.names if a.asname == a.name]})
                for a in s.names:
                    self.emit("binding", ord=self.items - 1, kind="star" if star else "symbol", name="*" if star else a.asname or a.name, target=s.module or "", level=s.level, names=[{"name": a.name, "alias": a.asname}])
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                now = self.signature(s)
                later, writes = self.body_names(s)
                self.item("FunctionDef", scope, s.name, roles={"decl": [s.name], "defined": [s.name], "read": reads(*now), "eventual_read": later, "eventual_write": writes}, deps=[(s.name, x) for x in reads(*now)], attrs=attributes(*now, *s.body))
                self.scoped_imports(s.body, s.name)
            case ast.ClassDef():
                now = [*s.bases, *[k.value for k in s.keywords], *s.decorator_list]
                later: list[str] = []
                for m in s.body:  # statements of the body run with the definition; methods, with all that belongs to them, do not order it
                    if isinstance(m, _DEFS):
                        later += [*reads(*self.signature(m)), *self.body_names(m)[0]]
                    elif isinstance(m, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
                        now += [x for x in (getattr(m, "annotation", None), m.value) if x is not None]
                    elif not isinstance(m, ast.ClassDef):
                        now.append(m)
                self.item("ClassDef", scope, s.name, roles={"decl": [s.name], "defined": [s.name], "read": reads(*now), "eventual_read": later}, deps=[(s.name, x) for x in reads(*s.bases, *[k.value for k in s.keywords])], attrs=attributes(*now, *s.body))
                self.scoped_imports(s.body, s.name)
            case ast.Assign():
                own = sorted({n for t in s.targets for n in target_names(t)})
                listed = string_list(s.value) if own == ["__all__"] else None
                plain = all(isinstance(t, (ast.Name, ast.Tuple, ast.List)) for t in s.targets)
                self.item("Assignment", scope, ",".join(own), effects=not plain or impure(s.value), roles={"decl": own, "defined": own, "read": reads(s.value, *s.targets), "write": [], "eventual_read": listed or []}, deps=[(o, r) for o in own for r in reads(s.value)], attrs=attributes(s.value, *s.targets))
            case ast.AnnAssign() | ast.AugAssign() | ast.TypeAlias():
                target = s.name if isinstance(s, ast.TypeAlias) else s.target
                own = target_names(target)
                extra = getattr(s, "annotation", None)
                again = own if isinstance(s, ast.AugAssign) else []
                self.item("Assignment", scope, ",".join(own), effects=impure(s.value) or isinstance(s, ast.AugAssign), roles={"decl": own, "defined": own, "read": [*again, *reads(extra, s.value)], "write": again}, deps=[(o, r) for o in own for r in reads(extra, s.value)], attrs=attributes(extra, s.value))
            case ast.Expr():
                constant = isinstance(s.value, ast.Constant)
                self.item("Expression", scope, effects=not constant and impure(s.value), roles={"read": reads(s.value)}, attrs=attributes(s.value))
            case ast.Assert():
                self.item("Assert", scope, effects=True, roles={"read": reads(s.test, s.msg)}, attrs=attributes(s.test, s.msg))
            case ast.Raise():
                self.item("Raise", scope, effects=True, roles={"read": reads(s.exc, s.cause)}, attrs=attributes(s.exc, s.cause))
            case ast.If() | ast.For() | ast.AsyncFor() | ast.While() | ast.With() | ast.AsyncWith() | ast.Try() | ast.TryStar() | ast.Match():
                heads = _heads(s)
                own = sorted({n for h in heads for n in target_names(h)})
                kind = type(s).__name__.removeprefix("Async").removesuffix("Star")
                checking = isinstance(s, ast.If) and type_checking(s.test) is not None
                effects = isinstance(s, ast.If) and not checking or isinstance(s, (ast.With, ast.AsyncWith, ast.While)) or any(impure(h) for h in heads)
                self.item(kind, scope, effects=effects, roles={"decl": own, "defined": own, "read": reads(*heads)}, attrs=attributes(*heads))
                for part in _bodies(s):
                    self.block(part, scope)
            case ast.Delete():
                self.item("Delete", scope, effects=True, roles={"write": [n for t in s.targets for n in target_names(t)]})

    def signature(self, f: ast.FunctionDef) -> list[ast.expr]:
        """What a definition evaluates at once: decorators, annotations, defaults."""
        a = f.args
        every = [*a.posonlyargs, *a.args, *a.kwonlyargs, *filter(None, [a.vararg, a.kwarg])]
        return [x for x in (*f.decorator_list, *(p.annotation for p in every), *a.defaults, *a.kw_defaults, f.returns) if x is not None]

    def body_names(self, f: ast.FunctionDef) -> tuple[list[str], list[str]]:
        """Names that a body reads once it runs (its locals and parameters aside), and globals that it writes."""
        for i, name in enumerate(sorted(local_names(f))):
            self.emit("local", ord=i, kind=f.name, name=name)
        for i, name in enumerate(used_symbols(f.body)):
            self.emit("used", ord=i, kind=f.name, name=name)
        return list(dict.fromkeys(free_reads(f))), sorted(global_writes(f))

    def scoped_imports(self, body: list[ast.stmt], scope: str) -> None:
        for s in body:
            if isinstance(s, (ast.Import, ast.ImportFrom)):
                self.statement(s, scope)
            elif isinstance(s, (*_DEFS, ast.ClassDef)):
                self.scoped_imports(s.body, s.name)
            elif isinstance(s, _BLOCKS):
                for part in _bodies(s):
                    self.scoped_imports(part, scope)

    # Symbols, usages, exports and globals.

    def symbols(self, body: list[ast.stmt], scope: str) -> None:
        for s in body:
            span = [str(s.lineno), str(s.end_lineno)]
            match s:
                case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
                    kind = "Class" if isinstance(s, ast.ClassDef) else "Function"
                    self.emit("symbol", kind=kind, name=s.name, target=scope, flag=scope == "module", scope=span)
                    self.symbols(s.body, f"{scope}.{s.name}")
                case ast.Assign() | ast.AnnAssign():
                    for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                        for n in target_names(t):
                            self.emit("symbol", kind="Variable", name=n, target=scope, flag=scope == "module", scope=span)
                case ast.Import() | ast.ImportFrom():
                    for a in s.names:
                        self.emit("symbol", kind="Import", name=a.asname or a.name.split(".")[0], target=scope, flag=scope == "module", scope=span)
            if isinstance(s, _BLOCKS):
                for part in _bodies(s):
                    self.symbols(part, scope)

    def usages(self, body: list[ast.AST], scope: str) -> None:
        """Each place of a name once, with the scope in which it stands."""
        for s in body:
            for x in own_nodes([s]):
                if isinstance(x, ast.Name):
                    self.emit("usage", ord=x.lineno, kind={"Load": "read", "Store": "write", "Del": "delete"}[type(x.ctx).__name__], name=x.id, target=scope)
                elif isinstance(x, (ast.Global, ast.Nonlocal)):
                    for n in x.names:
                        self.emit("usage", ord=x.lineno, kind=type(x).__name__.lower(), name=n, target=scope)
                elif isinstance(x, _SCOPES):
                    inner = x.body if isinstance(x.body, list) else [x.body]
                    self.usages(inner, f"{scope}.{getattr(x, 'name', '<lambda>')}")

    def exports(self, tree: ast.Module) -> None:
        """The last literal __all__; anything that changes it in place makes it dynamic."""
        listed, dynamic, seen = None, False, False
        for s in tree.body:
            if isinstance(s, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in s.targets) or isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name) and s.target.id == "__all__":
                seen, found = True, string_list(s.value) if s.value is not None else None
                listed, dynamic = (found, dynamic) if found is not None else (listed, True)
            elif isinstance(s, ast.AugAssign) and isinstance(s.target, ast.Name) and s.target.id == "__all__":
                seen, dynamic = True, True
        if seen:
            self.emit("export", flag=dynamic, scope=listed)

    def globals(self, tree: ast.Module) -> None:
        own = sorted({n for s in tree.body if isinstance(s, (ast.Assign, ast.AnnAssign)) for t in (s.targets if isinstance(s, ast.Assign) else [s.target]) for n in target_names(t)})
        for n in own:
            self.emit("global", kind="module_var", name=n)
        simple = {t.id for s in tree.body if isinstance(s, ast.Assign) for t in s.targets if isinstance(t, ast.Name)}
        for n in sorted(simple):
            self.emit("global", kind="liftable", name=n)
        for f in ast.walk(tree):
            if isinstance(f, _DEFS):
                for n in sorted({n for x in ast.walk(f) if isinstance(x, ast.Global) for n in x.names}):
                    self.emit("global", kind="declared", name=n, target=f.name)


def _bodies(s: ast.stmt) -> Iterator[list[ast.stmt]]:
    for field in ("body", "orelse", "finalbody"):
        if part := getattr(s, field, None):
            yield part
    for h in getattr(s, "handlers", ()):
        yield h.body
    for c in getattr(s, "cases", ()):
        yield c.body


def _heads(s: ast.stmt) -> list[ast.expr]:
    """The expressions that a compound statement evaluates itself."""
    found = [getattr(s, f) for f in ("test", "iter", "target", "subject") if hasattr(s, f)]
    found += [x for i in getattr(s, "items", ()) for x in (i.context_expr, i.optional_vars) if x is not None]
    return found + [h.type for h in getattr(s, "handlers", ()) if h.type is not None]


def records(module: str, path: str, source: str, stdlib: frozenset[str] = frozenset(sys.stdlib_module_names)) -> list[dict]:
    """All records of one module, or its error."""
    try:
        return Reader(module, path, source, stdlib).rows
    except (SyntaxError, ValueError, RecursionError) as e:
        return [{"module": module, "path": path, "record": "error", "kind": type(e).__name__, "name": str(e)}]


def parse(files: DataFrame) -> DataFrame:
    """The records of every file (module, path, source)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{f: None for f in _FIELDS} | r for r in records(row["module"], row["path"], row["source"] or "")], _SCHEMA)

    return files.select("module", "path", "source").mapInArrow(each, RECORD)


def table(parsed: DataFrame, record: str, **columns: str) -> DataFrame:
    """The records of one kind, with columns named as asked: new name = field."""
    return parsed.where(F.col("record") == record).select("module", *(F.col(field).alias(new) for new, field in columns.items()))


def imports(parsed: DataFrame) -> DataFrame:
    return table(parsed, "import", import_ord="ord", import_type="kind", name="name", level="level", names="names", scope_path="scope", execution_contexts="contexts", package_context="target", is_movable="flag")


def items(parsed: DataFrame) -> DataFrame:
    return table(parsed, "item", item_ord="ord", item_type="kind", name="name", from_module="target", level="level", has_side_effects="flag", containing_scope="scope").withColumn("containing_scope", F.col("containing_scope")[0])


def item_names(parsed: DataFrame) -> DataFrame:
    return table(parsed, "name", item_ord="ord", role="kind", name="name")


def bindings(parsed: DataFrame) -> DataFrame:
    return table(parsed, "binding", item_ord="ord", kind="kind", local="name", target="target", level="level", names="names").withColumn("original", F.col("names")[0]["name"]).drop("names")


def usages(parsed: DataFrame) -> DataFrame:
    return table(parsed, "usage", line="ord", usage="kind", name="name", scope="target")


def used(parsed: DataFrame) -> DataFrame:
    """Names that each function or method uses at run time."""
    return table(parsed, "used", function="kind", name="name")


def locals_of(parsed: DataFrame) -> DataFrame:
    return table(parsed, "local", function="kind", name="name")
