"""XPath trees as DataFrame plans over a node table.

An axis is a join, a node test a filter, a positional predicate a window, and set semantics a de-duplication. A step that starts at the document is a plain
scan, ``[@a]`` reads the attribute map, and an absolute path inside a predicate is evaluated once per document.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from canopyq.plans.strings import CELL, string_values

NODE = ["node_id", "parent_id", "kind", "kind_rank", "name", "value", "last_desc", "attrs"]
#: Ranks of atomic types: across types the rank decides a comparison.
BOOLEAN, INTEGER, FLOAT, DOUBLE, STRING = range(5)
TYPE_NAMES = ("boolean", "integer", "float", "double", "string")
ATOMIC_RANK = 6

RANGES = ("descendant", "descendant-or-self", "ancestor", "ancestor-or-self", "following", "preceding")
TOO_MANY = "XPTY0004: an operand has more than one item"
NO_TREAT = "XPDY0050: the sequence does not have the type"
NO_ITEM = "XPTY0020: the context item is not a node"


class UnsupportedError(ValueError):
    """An expression that parses but has no plan."""


@dataclass
class Seq:
    """Items of each context: a DataFrame with the key columns and those of a node. unique: no node twice under a key; top: only
    documents; full: all contexts of the query are there."""

    df: DataFrame
    keys: list[str]
    unique: bool = True
    top: bool = False
    full: bool = True


@dataclass
class Operand:
    """A value of each row: its type, the number of items (0 or 1; None: always 1) and the value."""

    type: int
    value: Column
    n: Column | None = None
    single: bool = True


@dataclass
class Compiler:
    """Builds plans over one node table. spec: follow the W3C rules where the default rules differ (see README); repeated: rows may be there more
    than once, and are made unique after the filters of each scan."""

    nodes: DataFrame
    spec: bool = False
    root_level: bool = True
    permissive: bool = False
    repeated: bool = False
    errors: list[DataFrame] = field(default_factory=list)
    #: Variables that are bound to nodes, and the key column that holds the node's id.
    bound: dict[str, str] = field(default_factory=dict)

    # contexts

    def carried(self, df: DataFrame) -> list[str]:
        """Key columns of variables that rows have."""
        return [k for k in self.bound.values() if k in df.columns]

    def candidates(self, df: DataFrame) -> Seq:
        """Each row's node as a context of its own, keyed by ck."""
        keys = ["doc_id", *self.carried(df)]
        return Seq(df.select(*keys, *NODE).dropDuplicates([*keys, "node_id"]).withColumn("ck", F.col("node_id")), [*keys, "ck"])

    def bind(self, ctx: Seq, name: str, source: tuple) -> Seq:
        """The contexts once for each node that a variable is bound to."""
        found, key = self.seq(source, ctx), f"x{self.fresh()}"
        self.bound = self.bound | {name: key}
        nodes = found.df.select(*ctx.keys, F.col("node_id").alias(key)).distinct()
        return Seq(ctx.df.select(*ctx.keys, *NODE).join(nodes, ctx.keys), [*ctx.keys, key], ctx.unique, False, False)

    def _loop(self, bindings: list, ctx: Seq, then):
        """What ``then`` makes of the contexts with all variables bound; they are not seen outside."""
        before = self.bound
        try:
            for name, source in bindings:
                ctx = self.bind(ctx, name, source)
            return then(ctx)
        finally:
            self.bound = before

    def documents(self) -> Seq:
        return Seq(self.once(self.nodes.filter("kind = 'document'").select("doc_id", *NODE)), ["doc_id"], True, True)

    def once(self, df: DataFrame) -> DataFrame:
        return df.dropDuplicates(["doc_id", "node_id"]) if self.repeated else df

    # sequences of nodes

    def seq(self, t: tuple, ctx: Seq) -> Seq:
        match t:
            case ("path", lead, steps):
                return self.path(lead, steps, ctx)
            case ("dot",):
                return ctx
            case ("step", *_):
                return self.path("", [("", t)], ctx)
            case ("paren", None):
                return replace(ctx, df=ctx.df.filter(F.lit(False)), top=False, full=False)
            case ("paren", e):
                return self.seq(e, ctx)
            case ("seq", items):
                return self.merge([self.seq(e, ctx) for e in items])
            case ("union", items):
                return self.merge([self.seq(e, ctx) for _, e in items])
            case ("intersect", items):
                left = self.seq(items[0][1], ctx)
                for op, e in items[1:]:
                    right = self.seq(e, ctx)
                    on = [*left.keys, "node_id"]
                    left = self.distinct(replace(left, df=left.df.join(right.df.select(*on), on, "left_semi" if op == "intersect" else "left_anti"), top=False))
                return left
            case ("call", name, _) if plain_name(name) == "root":
                up = ctx.df.select(*ctx.keys).distinct()
                docs = self.documents().df
                return Seq(up.join(docs, "doc_id"), ctx.keys, True, ctx.top and ctx.full)
            case ("treat", e, ty):
                return self.treat(self.seq(e, ctx), ty, ctx)
            case ("if", test, a, b):
                rows, cond = self.truth(test, ctx.df, ctx)
                yes, no = rows.filter(cond), rows.filter(~F.coalesce(cond, F.lit(False)))
                return self.merge([self.seq(a, replace(ctx, df=yes.select(*ctx.df.columns), top=False, full=False)), self.seq(b, replace(ctx, df=no.select(*ctx.df.columns), top=False, full=False))])
            case ("map", items):
                return self.path("", [("/", e) for _, e in items], ctx)
            case ("for", [(name, source)], body) if from_variable(body, name):
                return self.path("", [("", source), ("/", substitute(body, name, ("dot",)))], ctx)
            case ("for", bindings, body):

                def each(inner: Seq) -> Seq:
                    out = self.seq(body, inner)
                    return self.distinct(Seq(out.df.select(*ctx.keys, *NODE), ctx.keys, False))

                return self._loop(bindings, ctx, each)
            case ("var", name) if name in self.bound:
                key = self.bound[name]
                here = ctx.df.select(*ctx.keys).distinct()
                return Seq(here.join(self.once(self.nodes.select("doc_id", *NODE)).withColumn(key, F.col("node_id")), ["doc_id", key]), ctx.keys, True, False, False)
            case ("let", bindings, body):
                (name, source), *rest = bindings
                return self.seq(substitute(("let", rest, body) if rest else body, name, ("paren", source)), ctx)
            case ("postfix", base, rest):
                out = self.seq(base, ctx)
                for r in rest:
                    if r[0] != "predicate":
                        raise UnsupportedError("dynamic calls and lookups have no plan")
                    out = self.predicates(replace(out, df=out.df.withColumn("from_id", F.lit(0))), [r[1]], False, ctx)
                return out
        raise UnsupportedError(f"{t[0]} gives no nodes")

    def gives_nodes(self, t: tuple) -> bool:
        match t:
            case ("path", _, steps) if steps and steps[-1][1][0] != "step":
                return self.gives_nodes(steps[-1][1])
            case ("path" | "step" | "dot" | "union" | "intersect" | "treat", *_):
                return True
            case ("var", name):
                return name in self.bound
            case ("paren", None):
                return True
            case ("call", name, _) if plain_name(name) == "root":
                return True
            case ("paren", e) | ("postfix", e, _):
                return self.gives_nodes(e)
            case ("seq", items):
                return all(self.gives_nodes(e) for e in items)
            case ("map", items):
                return self.gives_nodes(items[-1][1])
            case ("if", _, a, b):
                return self.gives_nodes(a) and self.gives_nodes(b)
            case ("for" | "let", bindings, body):
                inside = [reduce(lambda e, b: substitute(e, b[0], ("dot",), strict=False), bindings[:k], e) for k, (_, e) in enumerate(bindings)]
                return self.gives_nodes(reduce(lambda e, b: substitute(e, b[0], ("dot",), strict=False), bindings, body)) and (t[0] == "let" or all(map(self.gives_nodes, inside)))
        return False

    def merge(self, parts: list[Seq]) -> Seq:
        df = reduce(lambda a, b: a.unionByName(b), [p.df.select(*p.keys, *NODE) for p in parts])
        return self.distinct(Seq(df, parts[0].keys, len(parts) == 1 and parts[0].unique))

    def distinct(self, s: Seq) -> Seq:
        return s if s.unique else replace(s, df=s.df.dropDuplicates([*s.keys, "node_id"]), unique=True)

    def path(self, lead: str, steps: list, ctx: Seq) -> Seq:
        here = ctx
        if lead:
            if self.root_level:
                here = self.documents()
                if not ctx.full and ctx.keys == ["doc_id"]:
                    here = replace(here, df=here.df.join(ctx.df.select("doc_id").distinct(), "doc_id", "left_semi"), top=False)
                elif ctx.keys != ["doc_id"]:
                    here = Seq(ctx.df.select(*ctx.keys).distinct().join(here.df, "doc_id"), ctx.keys, True, False)
            if steps:
                steps = [(lead if not self.root_level or lead == "//" else "", steps[0][1]), *steps[1:]]
        for sep, step in steps:
            here = self.step(sep, step, here, ctx)
        return here

    def step(self, sep: str, step: tuple, here: Seq, ctx: Seq) -> Seq:
        if step[0] != "step":
            if sep == "//":
                here = self.axis("descendant-or-self", ("kind", "node", None), here)
            return self.within(step, here)
        _, axis, test, predicates, _ = step
        if sep == "//":
            if axis == "child" and not any(self.positional(p) for p in predicates):
                axis = "descendant"
            elif axis == "child" and here.top:
                # positions count among the children of each parent, and every node below the document is the child of one
                found = Seq(self.scan(test, axis).filter("node_id > 0").withColumn("from_id", F.col("parent_id")), ["doc_id"], True)
                return self.predicates(found, predicates, False, ctx)
            else:
                here = self.axis("descendant-or-self", ("kind", "node", None), here)
        paired = any(self.positional(p) for p in predicates)
        found = self.axis(axis, test, here) if paired or here.keys != ["doc_id"] or here.top or axis not in RANGES else self.sweep(axis, test, here)
        return self.predicates(found, predicates, axis in ("ancestor", "ancestor-or-self", "preceding", "preceding-sibling", "parent"), ctx)

    def within(self, e: tuple, here: Seq) -> Seq:
        """An expression that is a step: evaluated for each node, and the results united."""
        if here.keys == ["doc_id"] and here.top:
            return self.seq(e, here)
        key = f"c{self.fresh()}"
        keys = ["doc_id", *self.carried(here.df)]
        inner = Seq(here.df.select(*keys, *NODE).dropDuplicates([*keys, "node_id"]).withColumn(key, F.col("node_id")), [*keys, key])
        out = self.seq(e, inner)
        back = here.df.select(*here.keys, F.col("node_id").alias(key))
        df = back.join(out.df, [*keys, key]).select(*here.keys, *NODE)
        return self.distinct(Seq(df, here.keys, False))

    # axes and node tests

    def test(self, t: tuple, axis: str) -> Column:
        kind, name = F.col("kind"), F.col("name")
        principal = "attribute" if axis == "attribute" else "element"
        named = kind == principal if self.spec or axis in ("attribute",) else kind.isin("element", "attribute")
        match t:
            case ("name", n):
                return named & (name == (n.rpartition("}")[2] if n.startswith("Q{") else n))
            case ("wildcard",):
                return kind == principal
            case ("anyprefix", n):
                return (kind == principal) & (F.element_at(F.split(name, ":"), -1) == n)
            case ("anylocal", n):
                return (kind == principal) & (name.startswith(n) if n.endswith(":") else F.lit(True))
            case ("kind", "node", _):
                return kind != "attribute" if axis != "attribute" else kind == "attribute"
            case ("kind", "text", _):
                return kind == "text"
            case ("kind", "document-node", _):
                return kind == "document"
            case ("kind", "attribute", arg):
                if arg in (None, "*"):
                    return F.lit(True) if not self.spec else kind == "attribute"
                return (kind == "attribute") & typed(name, arg, ("untypedAtomic", "anyAtomicType", "anySimpleType", "anyType"))
            case ("kind", "element", arg):
                return kind == "element" if arg in (None, "*") else (kind == "element") & typed(name, arg, ("untyped", "anyType"))
            case ("kind", "comment" | "namespace-node" | "processing-instruction", _):
                return F.lit(False)
        raise UnsupportedError(f"node test {t[1]} has no plan")

    def scan(self, test: tuple, axis: str) -> DataFrame:
        return self.once(self.rooted(self.nodes.filter(self.test(test, axis)).select("doc_id", *NODE), test))

    def rooted(self, df: DataFrame, test: tuple) -> DataFrame:
        """document-node(element(..)): documents whose root is such an element."""
        if test[:2] != ("kind", "document-node") or not isinstance(test[2], tuple):
            return df
        roots = self.nodes.filter("parent_id = 0 and node_id > 0").filter(self.test(test[2], "child"))
        return df.join(roots.select("doc_id").distinct(), "doc_id", "left_semi")

    def sweep(self, axis: str, test: tuple, here: Seq) -> Seq:
        """The nodes of an axis over ranges, of all context nodes of a document together: one pass over it in document order, no pairs."""
        n = self.scan(test, axis)
        if axis in ("following", "preceding"):
            # the context node that ends first, or begins last, has all that others have
            edge = here.df.groupBy("doc_id").agg((F.min("last_desc") if axis == "following" else F.max("node_id")).alias("edge"))
            beyond = F.col("node_id") > F.col("edge") if axis == "following" else F.col("last_desc") < F.col("edge")
            df = n.join(edge, "doc_id").filter(beyond & (F.col("kind") != "attribute")).drop("edge")
            return Seq(df.withColumn("from_id", F.lit(0)), ["doc_id"], True, False, False)
        rows = n.withColumn("start", F.lit(False)).unionByName(here.df.select("doc_id", *NODE).withColumn("start", F.lit(True)))
        upward, self_too = axis.startswith("ancestor"), axis.endswith("self")
        by = Window.partitionBy("doc_id").orderBy(F.col("node_id").desc() if upward else F.col("node_id")).rangeBetween(Window.unboundedPreceding, 0 if self_too else -1)
        if upward:
            # the next context node after this one is below it
            near = F.min(F.when(F.col("start"), F.col("node_id"))).over(by) <= F.col("last_desc")
            near = near & ((F.col("kind") != "attribute") | (F.min(F.when(F.col("start"), F.col("node_id"))).over(by) == F.col("node_id")))
        else:
            near = F.max(F.when(F.col("start"), F.col("last_desc"))).over(by) >= F.col("node_id")
        df = rows.withColumn("near", near).filter("near and not start").drop("near", "start")
        return Seq(df.withColumn("from_id", F.lit(0)), ["doc_id"], True, False, False)

    def axis(self, axis: str, test: tuple, here: Seq) -> Seq:
        """The nodes of an axis of each context node, with that node's id as from_id."""
        n = self.scan(test, axis)
        if here.top and here.keys == ["doc_id"] and axis in ("child", "descendant", "descendant-or-self", "self"):
            # the document is node 0: its children and descendants are a plain scan
            part = {"child": "parent_id = 0 and node_id > 0", "descendant": "node_id > 0", "descendant-or-self": "node_id >= 0", "self": "node_id = 0"}[axis]
            return Seq(n.filter(part).withColumn("from_id", F.lit(0)), ["doc_id"], True, axis == "self" and test[:2] in (("kind", "node"), ("kind", "document-node")))
        if axis == "namespace":
            return replace(here, df=here.df.select(*here.keys, *NODE).withColumn("from_id", F.lit(0)).filter(F.lit(False)), top=False)
        if axis == "self":
            return replace(here, df=here.df.select(*here.keys, *NODE).withColumn("from_id", F.col("node_id")).filter(self.test(test, axis)).transform(self.rooted, test))
        c = here.df.select(*here.keys, F.col("node_id").alias("from_id"), F.col("parent_id").alias("from_parent"), F.col("last_desc").alias("from_last"), F.col("kind").alias("from_kind"))
        c = c.withColumnRenamed("doc_id", "from_doc")
        keys = ["from_doc" if k == "doc_id" else k for k in here.keys]
        same = F.col("from_doc") == F.col("doc_id")
        this, start, last, up = F.col("node_id"), F.col("from_id"), F.col("from_last"), F.col("from_parent")
        no_attribute = (F.col("kind") != "attribute") & (F.col("from_kind") != "attribute")
        on: dict[str, Column] = {
            "child": F.col("parent_id") == start,
            "attribute": (F.col("parent_id") == start) & (F.col("kind") == "attribute") & (F.col("from_kind") == "element"),
            "descendant": (this > start) & (this <= last),
            "descendant-or-self": (this >= start) & (this <= last),
            "parent": this == up,
            "ancestor": (this < start) & (F.col("last_desc") >= start) & (F.col("kind") != "attribute"),
            "ancestor-or-self": (this <= start) & (F.col("last_desc") >= start) & ((F.col("kind") != "attribute") | (this == start)),
            "following-sibling": (F.col("parent_id") == up) & (this > start) & no_attribute,
            "preceding-sibling": (F.col("parent_id") == up) & (this < start) & no_attribute,
            "following": (this > last) & (F.col("kind") != "attribute"),
            "preceding": (F.col("last_desc") < start) & (F.col("kind") != "attribute"),
        }
        cells = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / CELL), F.floor(F.col(z) / CELL)))
        if axis.startswith("descendant"):
            # a context node meets only nodes in the cells of ids that its span covers; each node is in one cell
            c, n = c.withColumn("from_cell", cells("from_id", "from_last")), n.withColumn("cell", F.floor(F.col("node_id") / CELL))
            same = same & (F.col("from_cell") == F.col("cell"))
        elif axis.startswith("ancestor"):
            c, n = c.withColumn("from_cell", F.floor(F.col("from_id") / CELL)), n.withColumn("cell", cells("node_id", "last_desc"))
            same = same & (F.col("from_cell") == F.col("cell"))
        df = c.join(n, same & on[axis]).select(*[F.col(k) for k in keys if k != "from_doc"], "doc_id", *NODE, "from_id")
        if axis == "child" or axis == "attribute":
            unique = here.unique
        else:
            unique = False
        return Seq(df, here.keys, unique)

    # predicates

    def positional(self, p: tuple) -> bool:
        """Whether a predicate is a number, or looks at the position."""
        match p:
            case ("integer" | "decimal" | "double", *_):
                return True
            case ("paren", e) if e:
                return self.positional(e)
            case ("seq", items):
                return len({str(e) for e in items}) == 1 and self.positional(items[0])
            case ("path", _, steps) if steps:
                return steps[-1][1][0] != "step" and self.positional(steps[-1][1])
            case ("arithmetic" | "unary", *_):
                return True
            case ("call", name, args):
                return plain_name(name) in ("position", "last", "count", "string-length", "number", "sum") or any(looks_at_position(a) for a in args)
        return looks_at_position(p)

    def predicates(self, found: Seq, predicates: list, reverse: bool, ctx: Seq) -> Seq:
        """Keep what all predicates let through. By default they all see the position in the unfiltered step; with ``spec`` each sees what the one before left."""
        df = found.df
        for k, p in enumerate(predicates):
            if self.positional(p) and (k == 0 or self.spec or "pos" not in df.columns):
                if "pos" in df.columns:
                    df = df.drop("pos", "size")
                by = Window.partitionBy(*found.keys, "from_id")
                df = df.withColumn("pos", F.row_number().over(by.orderBy(F.col("node_id").desc() if reverse else F.col("node_id"))))
                if needs_last(p) or any(needs_last(q) for q in predicates):
                    df = df.withColumn("size", F.count(F.lit(1)).over(by))
            if not self.spec and k == 0 and not self.positional(p) and any(self.positional(q) for q in predicates[1:]):
                by = Window.partitionBy(*found.keys, "from_id")
                df = df.withColumn("pos", F.row_number().over(by.orderBy(F.col("node_id").desc() if reverse else F.col("node_id"))))
                if any(needs_last(q) for q in predicates):
                    df = df.withColumn("size", F.count(F.lit(1)).over(by))
            df = self.keep(p, df, replace(found, df=df))
        return self.distinct(replace(found, df=df.select(*found.keys, *NODE), top=found.top and not predicates))

    def keep(self, p: tuple, df: DataFrame, cand: Seq) -> DataFrame:
        columns = df.columns
        while p[0] == "paren" and p[1]:
            p = p[1]
        if p[0] == "path" or p[0] == "step":
            if (one := self.local_attribute(p)) is not None:
                return df.filter((F.col("kind") == "element") & F.map_contains_key("attrs", one))
            if not self.positional(p) and cand.keys == ["doc_id"] and (step := self.below(p)) is not None:
                # nodes above some node that the step finds: one sweep of the document
                found = self.step("//", step, self.documents(), cand)
                up = self.sweep("ancestor", ("kind", "node", None), found).df.select("doc_id", "node_id")
                return df.join(up, ["doc_id", "node_id"], "left_semi")
            if not self.positional(p):
                inner = self.related(p, df)
                return df.join(inner.df.select(*inner.keys).distinct().withColumnsRenamed({"ck": "node_id"}), self.on(inner.keys), "left_semi")
        rows, cond = self.truth(p, df, cand, position=True)
        return rows.filter(cond).select(*columns)

    def below(self, p: tuple) -> tuple | None:
        """The step, if an expression is just nodes at any depth below the candidate, without positions."""
        match p:
            case ("path", "", [("", ("dot",)), ("//", ("step", "child", test, found, sign))]):
                pass
            case ("path", "", [("", ("step", "descendant", test, found, sign))]):
                pass
            case _:
                return None
        return None if any(self.positional(q) or uses_variable(q) for q in found) else ("step", "child", test, found, sign)

    def local_attribute(self, p: tuple) -> str | None:
        """The name, if the expression is just an attribute of the candidate by name."""
        if p[0] == "path" and p[1] == "" and len(p[2]) == 1:
            p = p[2][0][1]
        if p[0] == "step" and p[1] == "attribute" and p[2][0] == "name" and not p[3]:
            return p[2][1]
        return None

    def related(self, t: tuple, df: DataFrame) -> Seq:
        """A node expression for each candidate: keyed by document alone if it is absolute, else by candidate (ck)."""
        return self.seq(t, self.around(t, df))

    def around(self, t: tuple, df: DataFrame) -> Seq:
        """The contexts of an expression: the documents alone if it is absolute, else each candidate."""
        return self.documents() if t[0] == "path" and t[1] and self.root_level and not uses_variable(t) else self.candidates(df)

    @staticmethod
    def on(keys: list[str]) -> list[str]:
        """Columns on which results for candidates join them."""
        return ["node_id" if k == "ck" else k for k in keys]

    # values

    def truth(self, t: tuple, df: DataFrame, cand: Seq, position: bool = False) -> tuple[DataFrame, Column]:
        """The effective boolean value of an expression for each row; a number as a predicate is compared with the position."""
        df, v = self.node_operand(t, df, cand, "exists") if self.gives_nodes(t) else self.operand(t, df, cand)
        if v.type == BOOLEAN:
            cond = v.value
        elif v.type == STRING:
            cond = F.length(v.value) > 0
        elif position and "pos" in df.columns:
            cond = F.col("pos").cast("double") == v.value.cast("double")
        else:
            cond = v.value != 0
        if v.n is not None:
            cond = (v.n > 0) & cond
        return df, F.coalesce(cond, F.lit(False))

    def one(self, df: DataFrame, n: Column) -> tuple[DataFrame, Column]:
        """Refuse more than one item, by an error of the job or by a row in the errors."""
        if self.permissive:
            self.errors.append(df.filter(n > 1).select("doc_id", F.lit(TOO_MANY[:8]).alias("error_code"), F.lit(TOO_MANY[10:]).alias("error_msg")))
            return df, n
        # a filter of its own, which no value that is not needed takes away
        return df.filter(F.when(n > 1, F.raise_error(F.lit(TOO_MANY)).cast("boolean")).otherwise(F.lit(True))), n

    def fresh(self) -> str:
        self._count = getattr(self, "_count", 0) + 1
        return f"v{self._count}"

    def node_operand(self, t: tuple, df: DataFrame, cand: Seq, how: str = "string") -> tuple[DataFrame, Operand]:
        if how in ("string", "exists") and (name := self.local_attribute(t)) is not None:
            value = F.when(F.col("kind") == "element", F.try_element_at("attrs", F.lit(name)))
            here = (F.col("kind") == "element") & F.map_contains_key("attrs", F.lit(name))
            return df, Operand(STRING, value, F.coalesce(here, F.lit(False)).cast("int")) if how == "string" else Operand(BOOLEAN, F.coalesce(here, F.lit(False)))
        inner = self.related(t, df)
        name = self.fresh()
        on = self.on(inner.keys)
        many = inner.df.select(*inner.keys, F.col("node_id").alias("nid"), "kind", "value", F.col("last_desc").alias("nlast"))
        if how == "string" and may_be_element(t):
            many = self.with_text(many, inner.keys)
        agg = many.groupBy(*inner.keys).agg(F.count(F.lit(1)).alias(f"{name}n"), F.min_by("value", "nid").alias(name)).withColumnsRenamed({"ck": "node_id"})
        df = df.join(agg, on, "left")
        n = F.coalesce(F.col(f"{name}n"), F.lit(0))
        if how == "count":
            return df, Operand(INTEGER, n)
        if how == "exists":
            return df, Operand(BOOLEAN, n > 0)
        df, n = self.one(df, n)
        return df, Operand(STRING, F.col(name), n)

    def with_text(self, many: DataFrame, keys: list[str]) -> DataFrame:
        """String values: of elements and documents the text below them, in document order."""
        holds = F.col("kind").isin("element", "document")
        texts = self.once(self.nodes.filter("kind = 'text'").select("doc_id", "node_id", "value"))
        below = string_values(texts, many.filter(holds).select("doc_id", "nid", "nlast").distinct())
        out = many.join(below, ["doc_id", "nid"], "left").withColumn("value", F.when(holds, F.coalesce("text", F.lit(""))).otherwise(F.col("value")))
        return out.drop("text")

    def operand(self, t: tuple, df: DataFrame, cand: Seq) -> tuple[DataFrame, Operand]:
        match t:
            case ("string", s, _):
                return df, Operand(STRING, F.lit(s))
            case ("integer", s):
                return df, Operand(INTEGER, F.lit(int(s)).cast("long"))
            case ("decimal", s):
                return df, Operand(FLOAT, F.lit(float(s)).cast("float"))
            case ("double", s):
                return df, Operand(DOUBLE, F.lit(float(s)))
            case ("paren", e) if e is not None and not self.gives_nodes(e):
                return self.operand(e, df, cand)
            case ("seq", items) if not self.gives_nodes(t):
                if len({str(e) for e in items}) == 1:
                    return self.operand(items[0], df, cand)
                df, first = self.operand(items[0], df, cand)
                # counted on data, so that no plan is without the check
                return df, replace(first, n=F.lit(len({str(e) for e in items})) + F.pmod("doc_id", F.lit(1)).cast("int"))
            case ("dot",):
                if "node_id" not in df.columns:
                    raise UnsupportedError(NO_ITEM)
                return self.node_operand(t, df, cand)
            case ("path", _, steps) if steps and steps[-1][1][0] in ("integer", "decimal", "double", "string"):
                before = ("path", t[1], steps[:-1])
                df, there = self.node_operand(before, df, cand, "exists")
                df, v = self.operand(steps[-1][1], df, cand)
                return df, Operand(v.type, v.value, there.value.cast("int"))
            case ("path" | "map" | "for" | "range" | "postfix", *_) if not self.gives_nodes(t):
                return self.folded(t, df, "first")
            case ("compare", op, a, b):
                return self.compare(op, a, b, df, cand)
            case ("and" | "or", items):
                conds = []
                for _, e in items:
                    df, c = self.truth(e, df, cand)
                    conds.append(c)
                return df, Operand(BOOLEAN, reduce(lambda x, y: x & y if t[0] == "and" else x | y, conds))
            case ("concat", items):
                parts = []
                for _, e in items:
                    df, v = self.text(e, df, cand)
                    parts.append(v)
                return df, Operand(STRING, F.concat(*parts))
            case ("arithmetic", items):
                return self.arithmetic(items, df, cand)
            case ("unary", signs, e):
                df, v = self.number(e, df, cand)
                return df, replace(v, value=-v.value if signs.count("-") % 2 else v.value)
            case ("if", c, a, b):
                df, cond = self.truth(c, df, cand)
                df, x = self.operand(a, df, cand)
                df, y = self.operand(b, df, cand)
                if x.type != y.type:
                    raise UnsupportedError("both branches of if must have one type")
                n = F.when(cond, one_or(x)).otherwise(one_or(y))
                return df, Operand(x.type, F.when(cond, x.value).otherwise(y.value), n)
            case ("quantified", kind, [(name, source)], body) if from_variable(body, name, True):
                body = substitute(body, name, ("dot",))
                if kind == "every":
                    body = ("call", "not", [body])
                df, v = self.node_operand(("postfix", source, [("predicate", body)]) if source[0] != "path" else with_predicate(source, body), df, cand, "exists")
                return df, Operand(BOOLEAN, v.value if kind == "some" else ~v.value)
            case ("quantified", kind, bindings, body):

                def hits(inner: Seq) -> DataFrame:
                    rows, cond = self.truth(body if kind == "some" else ("call", "not", [body]), inner.df, inner)
                    return rows.filter(cond).select(*start.keys).distinct()

                start, name = self.candidates(df), self.fresh()
                hit = self._loop(bindings, start, hits).withColumn(name, F.lit(True)).withColumnsRenamed({"ck": "node_id"})
                df = df.join(hit, self.on(start.keys), "left")
                there = F.coalesce(F.col(name), F.lit(False))
                return df, Operand(BOOLEAN, there if kind == "some" else ~there)
            case ("let", bindings, body):
                (name, source), *rest = bindings
                return self.operand(substitute(("let", rest, body) if rest else body, name, ("paren", source)), df, cand)
            case ("instance", e, ty):
                df, ok = self.is_type(e, ty, df, cand)
                return df, Operand(BOOLEAN, ok)
            case ("cast" | "castable", e, ty):
                return self.cast(t[0], e, ty, df, cand)
            case ("arrow", e, ("name", f), args):
                return self.call(f, [e, *args], df, cand)
            case ("call", name, args) if not self.gives_nodes(t):
                return self.call(name, args, df, cand)
        if self.gives_nodes(t):
            return self.node_operand(t, df, cand)
        raise UnsupportedError(f"{t[0]} has no plan")

    def compare(self, op: str, a: tuple, b: tuple, df: DataFrame, cand: Seq) -> tuple[DataFrame, Operand]:
        if op in ("is", "<<", ">>"):
            ids = []
            for e in (a, b):
                inner = self.related(e, df)
                name = self.fresh()
                agg = inner.df.groupBy(*inner.keys).agg(F.min("node_id").alias(name)).withColumnsRenamed({"ck": "node_id"})
                df = df.join(agg, self.on(inner.keys), "left")
                ids.append(F.col(name))
            cond = {"is": ids[0] == ids[1], "<<": ids[0] < ids[1], ">>": ids[0] > ids[1]}[op]
            return df, Operand(BOOLEAN, F.coalesce(cond, F.lit(False)))
        if self.spec and not op.isalpha() and (self.may_be_many(a) or self.may_be_many(b)):
            return self.compare_any(op, a, b, df, cand)
        df, x = self.operand(a, df, cand)
        df, y = self.operand(b, df, cand)
        for v, e in ((x, a), (y, b)):
            if v.n is not None and self.sequence(e):
                df, _ = self.one(df, v.n)
        value_like = op.isalpha() or self.spec
        op = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.get(op, op)
        left, right = x.value, y.value
        if x.type != y.type and value_like:
            left, right = left.try_cast("double"), right.try_cast("double")
        if x.type == y.type or value_like:
            cond = {"=": left == right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
        else:
            holds = {"=": False, "!=": True, "<": x.type < y.type, "<=": x.type < y.type, ">": x.type > y.type, ">=": x.type > y.type}[op]
            n = next((v.n for v in (x, y) if v.n is not None), None)
            cond = F.lit(holds) if n is None else n >= 0 if holds else n < 0
        here = [v.n > 0 for v in (x, y) if v.n is not None]
        for h in here:
            cond = h & cond
        return df, Operand(BOOLEAN, F.coalesce(cond, F.lit(False)))

    def sequence(self, t: tuple) -> bool:
        """Whether an expression is a list of values."""
        return t[0] == "seq" or t[0] == "paren" and t[1] is not None and self.sequence(t[1])

    def may_be_many(self, t: tuple) -> bool:
        return self.local_attribute(t) is None and (self.gives_nodes(t) or self.sequence(t) or t[0] in ("path", "map", "for", "range") or t[0] == "call" and plain_name(t[1]) in SEVERAL)

    def compare_any(self, op: str, a: tuple, b: tuple, df: DataFrame, cand: Seq) -> tuple[DataFrame, Operand]:
        """A general comparison by the W3C rules: true if it holds for some pair of items. Values of nodes are numbers where the other side is one."""
        df, (xs, x_type) = self.listed(a, df, cand)
        df, (ys, y_type) = self.listed(b, df, cand)
        numeric = x_type != y_type or x_type in (INTEGER, FLOAT, DOUBLE)
        if numeric and BOOLEAN not in (x_type, y_type):
            xs, ys = (F.transform(v, lambda e: e.try_cast("double")) for v in (xs, ys))
        holds = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
        cond = F.exists(xs, lambda x: F.coalesce(F.exists(ys, lambda y: F.coalesce(holds(x, y), F.lit(False))), F.lit(False)))
        return df, Operand(BOOLEAN, F.coalesce(cond, F.lit(False)))

    def listed(self, t: tuple, df: DataFrame, cand: Seq) -> tuple[DataFrame, tuple[Column, int]]:
        """All items of an expression for each row as an array of strings, and their type."""
        if not self.may_be_many(t):
            df, v = self.operand(t, df, cand)
            value = F.array(as_text(v))
            return df, (value if v.n is None else F.when(v.n > 0, value).otherwise(F.array().cast("array<string>")), v.type)
        df, v = self.folded(t, df, "list")
        return df, (v.value, v.type)

    # several atomic values

    def atoms(self, t: tuple, ctx: Seq) -> list[tuple[DataFrame, int]]:
        """The items of an expression as atomic values: rows of the keys, o (an order) and v (a string), with their type, in parts of one type each."""
        if self.gives_nodes(t):
            found = self.seq(t, ctx)
            rows = found.df.select(*ctx.keys, F.col("node_id").alias("nid"), "kind", "value", F.col("last_desc").alias("nlast"))
            if may_be_element(t):
                rows = self.with_text(rows, ctx.keys)
            return [(rows.select(*ctx.keys, F.col("nid").alias("o"), F.coalesce("value", F.lit("")).alias("v")), STRING)]
        match t:
            case ("paren", e) if e:
                return self.atoms(e, ctx)
            case ("paren", None):
                return [(ctx.df.select(*ctx.keys, F.lit(0).alias("o"), F.lit("").alias("v")).filter(F.lit(False)), STRING)]
            case ("seq", items):
                return [part for e in items for part in self.atoms(e, ctx)]
            case ("path", lead, steps):
                return self.atoms_of_each(steps[-1][1], self.path(lead, steps[:-1], ctx), ctx)
            case ("map", items):
                return self.atoms_of_each(items[-1][1], self.path("", [("/", e) for _, e in items[:-1]], ctx), ctx)
            case ("for", bindings, body):
                return self._loop(bindings, ctx, lambda inner: [(df.select(*ctx.keys, "o", "v"), ty) for df, ty in self.atoms(body, inner)])
            case ("postfix", base, [("predicate", ("integer", k)), *rest]):
                parts = self.atoms(base, ctx)
                if len({ty for _, ty in parts}) > 1:
                    raise UnsupportedError("a position among values of several types has no plan")
                rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(n)).withColumn("o", F.col("o").cast("long")) for n, (p, _) in enumerate(parts)])
                rows = rows.withColumn("at", F.row_number().over(Window.partitionBy(*ctx.keys).orderBy("part", "o"))).filter(F.col("at") == int(k))
                if rest:
                    raise UnsupportedError("only one position of values has a plan")
                return [(rows.select(*ctx.keys, "o", "v"), parts[0][1])]
            case ("let", bindings, body):
                (name, source), *rest = bindings
                return self.atoms(substitute(("let", rest, body) if rest else body, name, ("paren", source)), ctx)
            case ("if", test, a, b):
                rows, cond = self.truth(test, ctx.df, ctx)
                no = ~F.coalesce(cond, F.lit(False))
                here = lambda c: replace(ctx, df=rows.filter(c).select(*ctx.df.columns), top=False, full=False)
                return self.atoms(a, here(cond)) + self.atoms(b, here(no))
            case ("range", a, b):
                df, x = self.number(a, ctx.df, ctx)
                df, y = self.number(b, df, ctx)
                whole = [v.value.cast("long") for v in (x, y)]
                for v in (x, y):
                    df = df if v.n is None else df.filter(v.n > 0)
                rows = df.filter(whole[0] <= whole[1]).select(*ctx.keys, F.explode(F.sequence(*whole)).alias("k"))
                return [(rows.select(*ctx.keys, F.col("k").alias("o"), F.col("k").cast("string").alias("v")), INTEGER)]
            case ("arrow", e, ("name", f), args) if plain_name(f) in SEVERAL:
                return self.atoms(("call", f, [e, *args]), ctx)
            case ("call", name, args) if plain_name(name) in SEVERAL:
                f = plain_name(name)
                if f == "data":
                    return self.atoms(args[0] if args else ("dot",), ctx)
                if f == "distinct-values":
                    return [(df.groupBy(*ctx.keys, "v").agg(F.min("o").alias("o")).select(*ctx.keys, "o", "v"), ty) for df, ty in self.atoms(args[0], ctx)]
                df, v = self.text(args[0], ctx.df, ctx)
                by = r"\s+"
                if len(args) > 1:
                    df, by = self.text(args[1], df, ctx)
                v = F.trim(v) if len(args) == 1 else v
                rows = df.filter(F.length(v) > 0).select(*ctx.keys, F.posexplode(F.split(v, by)).alias("o", "v"))
                return [(rows.select(*ctx.keys, "o", "v"), STRING)]
        df, v = self.operand(t, ctx.df, ctx)
        if v.n is not None:
            df = df.filter(v.n > 0)
        order = F.col("node_id") if "node_id" in df.columns else F.lit(0)
        return [(df.select(*ctx.keys, order.alias("o"), as_text(v).alias("v")), v.type)]

    def atoms_of_each(self, e: tuple, here: Seq, ctx: Seq) -> list[tuple[DataFrame, int]]:
        """The values that an expression gives for each of many nodes."""
        keys = ["doc_id", *self.carried(here.df)]
        key = f"c{self.fresh()}"
        inner = Seq(here.df.select(*keys, *NODE).dropDuplicates([*keys, "node_id"]).withColumn(key, F.col("node_id")), [*keys, key])
        back = here.df.select(*here.keys, F.col("node_id").alias(key))
        return [(back.join(df, [*keys, key]).select(*ctx.keys, F.col(key).alias("o"), "v"), ty) for df, ty in self.atoms(e, inner)]

    def folded(self, t: tuple, df: DataFrame, how: str, between: str = "") -> tuple[DataFrame, Operand]:
        """One value of all items of an expression for each row."""
        ctx = self.around(t, df)
        parts = self.atoms(t, ctx)
        types = {ty for _, ty in parts}
        rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(k)).withColumn("o", F.col("o").cast("long")) for k, (p, _) in enumerate(parts)])
        ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "o", "v"))), lambda x: x["v"])
        number = F.col("v").try_cast("double")
        value, ty = {
            "count": (F.count(F.lit(1)), INTEGER),
            "list": (ordered, next(iter(types)) if len(types) == 1 else STRING),
            "first": (F.min_by("v", F.struct("part", "o")), next(iter(types)) if len(types) == 1 else STRING),
            "string-join": (F.array_join(ordered, between), STRING),
            "sum": (F.sum(number), DOUBLE),
            "avg": (F.avg(number), DOUBLE),
            "min": (F.min("v") if types == {STRING} and how == "text" else F.min(number), DOUBLE),
            "max": (F.max(number), DOUBLE),
        }[how]
        name = self.fresh()
        agg = rows.groupBy(*ctx.keys).agg(value.alias(name), F.count(F.lit(1)).alias(f"{name}n")).withColumnsRenamed({"ck": "node_id"})
        df = df.join(agg, self.on(ctx.keys), "left")
        n = F.coalesce(F.col(f"{name}n"), F.lit(0))
        out = F.col(name)
        if how in ("count", "sum"):
            return df, Operand(ty, F.coalesce(out, F.lit(0).cast("double" if how == "sum" else "long")))
        if how == "string-join":
            return df, Operand(STRING, F.coalesce(out, F.lit("")))
        if how == "list":
            return df, Operand(ty, F.coalesce(out, F.array().cast("array<string>")))
        if how == "first":
            df, n = self.one(df, n)
            return df, Operand(ty, out.try_cast(("boolean", "long", "float", "double", "string")[ty]), n)
        return df, Operand(ty, out, n)

    def number(self, e: tuple, df: DataFrame, cand: Seq) -> tuple[DataFrame, Operand]:
        df, v = self.operand(e, df, cand)
        return df, v if v.type in (INTEGER, FLOAT, DOUBLE) else Operand(DOUBLE, v.value.try_cast("double"), v.n)

    def arithmetic(self, items: list, df: DataFrame, cand: Seq) -> tuple[DataFrame, Operand]:
        df, acc = self.number(items[0][1], df, cand)
        for op, e in items[1:]:
            df, v = self.number(e, df, cand)
            x, y, ty = acc.value, v.value, max(acc.type, v.type)
            if op == "idiv":
                out, ty = F.floor(F.abs(x) / F.abs(y)) * F.signum(x.cast("double") * y.cast("double")), INTEGER
                out = out.cast("long")
            elif op == "div":
                out, ty = x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0)), max(ty, FLOAT) if ty != INTEGER else DOUBLE
            else:
                out = {"+": x + y, "-": x - y, "*": x * y, "mod": x % F.nullif(y, F.lit(0))}[op]
            n = [v.n for v in (acc, v) if v.n is not None]
            acc = Operand(ty, out, reduce(F.least, n) if n else None)
        return df, acc

    def text(self, e: tuple, df: DataFrame, cand: Seq) -> tuple[DataFrame, Column]:
        """The string value of an expression; "" where it is empty."""
        df, v = self.operand(e, df, cand)
        return df, F.coalesce(F.when(F.lit(True) if v.n is None else v.n > 0, as_text(v)), F.lit(""))

    def call(self, name: str, args: list, df: DataFrame, cand: Seq) -> tuple[DataFrame, Operand]:
        f = plain_name(name)
        if any(a == ("placeholder",) for a in args):
            raise UnsupportedError("partial application has no plan")
        if f in ("sum", "avg", "min", "max"):
            if len(args) != 1:
                raise ValueError(f"{name} takes 1 argument")
            return self.folded(args[0], df, f)
        if f == "string-join":
            between = args[1] if len(args) > 1 else ("string", "", "")
            if between[0] != "string":
                raise UnsupportedError("string-join takes a literal separator")
            return self.folded(args[0], df, f, between[1])
        if f in SEVERAL:
            return self.folded(("call", name, args), df, "first")

        def arity(*allowed: int) -> None:
            if len(args) not in allowed:
                raise ValueError(f"{name} takes {' or '.join(map(str, allowed))} arguments")

        strings: dict[str, Callable[..., Column]] = {
            "contains": lambda a, b: F.contains(a, b),
            "starts-with": lambda a, b: F.startswith(a, b),
            "ends-with": lambda a, b: F.endswith(a, b),
            "matches": lambda a, b: F.regexp_like(a, b),
        }
        if f in ("contains", "starts-with", "ends-with", "matches"):
            arity(2)
            df, a = self.text(args[0], df, cand)
            df, b = self.text(args[1], df, cand)
            return df, Operand(BOOLEAN, strings[f](a, b))
        if f in ("substring-before", "substring-after"):
            arity(2)
            df, a = self.text(args[0], df, cand)
            df, b = self.text(args[1], df, cand)
            at = F.position(b, a)
            out = F.when(at == 0, F.lit("")).otherwise(F.substring(a, F.lit(1), at - 1) if f == "substring-before" else F.substring(a, at + F.length(b), F.length(a)))
            return df, Operand(STRING, out)
        if f in ("string", "string-length", "normalize-space", "upper-case", "lower-case", "number"):
            arity(0, 1)
            df, a = self.text(args[0] if args else ("dot",), df, cand)
            white = r"[\t-\r \u0085   -     　]+"
            out = {"string": a, "string-length": F.length(a).cast("long"), "normalize-space": F.trim(F.regexp_replace(a, white, " ")), "upper-case": F.upper(a), "lower-case": F.lower(a), "number": a.try_cast("double")}[f]
            return df, Operand({"string-length": INTEGER, "number": DOUBLE}.get(f, STRING), out)
        if f == "concat":
            parts = []
            for e in args:
                df, v = self.text(e, df, cand)
                parts.append(v)
            return df, Operand(STRING, F.concat(*parts))
        if f == "substring":
            arity(2, 3)
            df, a = self.text(args[0], df, cand)
            df, s = self.number(args[1], df, cand)
            start = F.round(s.value).cast("int")
            length = F.length(a)
            if len(args) == 3:
                df, n = self.number(args[2], df, cand)
                length = F.round(n.value).cast("int") + F.least(start, F.lit(1)) - 1
            return df, Operand(STRING, F.substring(a, F.greatest(start, F.lit(1)), F.greatest(length, F.lit(0))))
        if f in ("name", "local-name"):
            arity(0, 1)
            value = F.coalesce(F.col("name"), F.lit(""))
            if args and args[0] != ("dot",):
                inner, column = self.related(args[0], df), self.fresh()
                agg = inner.df.groupBy(*inner.keys).agg(F.min_by("name", "node_id").alias(column)).withColumnsRenamed({"ck": "node_id"})
                df = df.join(agg, self.on(inner.keys), "left")
                value = F.coalesce(F.col(column), F.lit(""))
            return df, Operand(STRING, value if f == "name" else F.element_at(F.split(value, ":"), -1))
        if f in ("true", "false"):
            arity(0)
            return df, Operand(BOOLEAN, F.lit(f == "true"))
        if f in ("not", "boolean"):
            arity(1)
            df, c = self.truth(args[0], df, cand) if not self.gives_nodes(args[0]) else (lambda r: (r[0], r[1].value))(self.node_operand(args[0], df, cand, "exists"))
            return df, Operand(BOOLEAN, ~c if f == "not" else c)
        if f in ("abs", "floor", "ceiling", "round"):
            arity(1)
            df, v = self.number(args[0], df, cand)
            x = v.value
            out = {"abs": F.abs(x), "floor": F.floor(x), "ceiling": F.ceil(x), "round": F.floor(x + 0.5)}[f]
            return df, replace(v, value=out.cast("long" if v.type == INTEGER else "double"), type=INTEGER if v.type == INTEGER else DOUBLE)
        if f == "replace":
            arity(3)
            df, a = self.text(args[0], df, cand)
            df, b = self.text(args[1], df, cand)
            df, c = self.text(args[2], df, cand)
            return df, Operand(STRING, F.regexp_replace(a, b, c))
        if f == "translate":
            arity(3)
            df, a = self.text(args[0], df, cand)
            if args[1][0] != "string" or args[2][0] != "string":
                raise UnsupportedError("translate takes literal characters")
            return df, Operand(STRING, F.translate(a, args[1][1], args[2][1]))
        if f in ("exists", "empty") and not self.gives_nodes(args[0]):
            df, v = self.folded(args[0], df, "count")
            return df, Operand(BOOLEAN, v.value > 0 if f == "exists" else v.value == 0)
        if f in ("exists", "empty"):
            arity(1)
            df, v = self.node_operand(args[0], df, cand, "exists")
            return df, Operand(BOOLEAN, v.value if f == "exists" else ~v.value)
        if f == "count":
            arity(1)
            if not self.gives_nodes(args[0]):
                return self.folded(args[0], df, "count")
            return self.node_operand(args[0], df, cand, "count")
        if f in ("position", "last"):
            arity(0)
            column = "pos" if f == "position" else "size"
            return df, Operand(INTEGER, F.col(column).cast("long") if column in df.columns else F.lit(1).cast("long"))
        raise ValueError(f"Unknown function {name}")

    # types

    def matches(self, item: str | tuple) -> Column:
        if isinstance(item, tuple) and item[0] == "parenthesized":
            return self.matches(item[1])
        if item == "item()":
            return F.lit(True)
        if isinstance(item, tuple):
            return F.col("kind").isNotNull() if item[1] == "node" else self.test(item, "child") if item[1] != "attribute" else F.col("kind") == "attribute"
        return F.lit(False)

    def is_type(self, e: tuple, ty: tuple, df: DataFrame, cand: Seq) -> tuple[DataFrame, Column]:
        if not self.gives_nodes(e):
            df, v = self.operand(e, df, cand)
            own = {BOOLEAN: ("boolean",), INTEGER: ("integer", "decimal"), FLOAT: ("float", "decimal"), DOUBLE: ("double",), STRING: ("string",)}[v.type]
            ok = isinstance(ty[1], str) and (ty[1] == "item()" or ty[1].split(":")[-1] in (*own, "anyAtomicType"))
            n = F.lit(1) if v.n is None else v.n
            return df, fits(ty, n) & (F.lit(ok) | (n == 0))
        inner = self.related(e, df)
        name = self.fresh()
        wrong = F.count_if(~self.matches(ty[1])) if ty[1] != "empty-sequence()" else F.lit(0)
        agg = inner.df.groupBy(*inner.keys).agg(F.count(F.lit(1)).alias(f"{name}n"), wrong.alias(f"{name}w")).withColumnsRenamed({"ck": "node_id"})
        df = df.join(agg, self.on(inner.keys), "left")
        n, w = F.coalesce(F.col(f"{name}n"), F.lit(0)), F.coalesce(F.col(f"{name}w"), F.lit(0))
        return df, fits(ty, n) & (w == 0)

    def treat(self, s: Seq, ty: tuple, ctx: Seq) -> Seq:
        """The sequence, if it has the type in every context, contexts without any item included."""
        wrong = F.count_if(~self.matches(ty[1])) if ty[1] != "empty-sequence()" else F.lit(0)
        agg = s.df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"), wrong.alias("w"))
        every = ctx.df.select(*ctx.keys).distinct().join(agg, ctx.keys, "left")
        n, w = F.coalesce(F.col("n"), F.lit(0)), F.coalesce(F.col("w"), F.lit(0))
        bad = every.filter(~(fits(ty, n) & (w == 0)))
        if self.permissive:
            self.errors.append(bad.select("doc_id", F.lit(NO_TREAT[:8]).alias("error_code"), F.lit(NO_TREAT[10:]).alias("error_msg")))
            return s
        empty = self.nodes.select("doc_id", *NODE).schema
        raised = bad.select(*[F.raise_error(F.lit(NO_TREAT)).cast(f.dataType).alias(f.name) if f.name == "node_id" else F.lit(None).cast(f.dataType).alias(f.name) if f.name not in s.keys else F.col(f.name) for f in empty.fields], *[k for k in s.keys if k not in empty.names])
        df = s.df.select(*s.keys, *NODE)
        return replace(s, df=df.unionByName(raised.select(*df.columns)), top=False)

    def cast(self, what: str, e: tuple, ty: tuple, df: DataFrame, cand: Seq) -> tuple[DataFrame, Operand]:
        to = {"integer": ("long", INTEGER), "int": ("long", INTEGER), "long": ("long", INTEGER), "float": ("float", FLOAT), "decimal": ("double", DOUBLE), "double": ("double", DOUBLE), "string": ("string", STRING), "boolean": ("boolean", BOOLEAN)}
        name = ty[1].split(":")[-1]
        if name not in to:
            raise UnsupportedError(f"type {ty[1]} has no plan")
        df, v = self.operand(e, df, cand)
        out = (F.trim(v.value) if v.type == STRING else v.value).try_cast(to[name][0]) if name != "string" else as_text(v)
        n = F.lit(1) if v.n is None else v.n
        if what == "castable":
            return df, Operand(BOOLEAN, (out.isNotNull() & (n > 0)) | ((n == 0) & F.lit(ty[2] == "?")))
        return df, Operand(to[name][1], out, n)


def typed(name: Column, arg: str, types: tuple[str, ...]) -> Column:
    """A name or *, and perhaps a type: nodes of HTML have no types but the general ones."""
    wanted, _, ty = (x.strip() for x in arg.partition(","))
    if ty and ty.rstrip("?").split(":")[-1] not in types:
        return F.lit(False)
    return F.lit(True) if wanted == "*" else name == wanted


def fits(ty: tuple, n: Column) -> Column:
    if ty[1] == "empty-sequence()":
        return n == 0
    return {"": n == 1, "?": n <= 1, "+": n >= 1, "*": n >= 0}[ty[2]]


def one_or(v: Operand) -> Column:
    return F.lit(1) if v.n is None else v.n


def as_text(v: Operand) -> Column:
    """A value as a string; whole floating numbers without a fraction."""
    if v.type in (FLOAT, DOUBLE):
        whole = (v.value == F.floor(v.value)) & (F.abs(v.value) < 1e15)
        return F.when(whole, F.floor(v.value).cast("long").cast("string")).otherwise(v.value.cast("string"))
    return v.value.cast("string")


def may_be_element(t: tuple) -> bool:
    """Whether a node expression can give elements or documents, whose string value is the text below them."""
    match t:
        case ("step", "attribute", *_) | ("step", _, ("kind", "text", _), *_):
            return False
        case ("path", _, steps) if steps:
            return may_be_element(steps[-1][1])
        case ("paren", e) if e:
            return may_be_element(e)
    return True


#: Functions that can give several values.
SEVERAL = ("data", "distinct-values", "tokenize")
_FUNCTIONS = "Q{http://www.w3.org/2005/xpath-functions}"


def plain_name(name: str) -> str:
    """A function's name without the prefix or address of its namespace."""
    return name.removeprefix(_FUNCTIONS).removeprefix("fn:")


def uses_variable(t) -> bool:
    return isinstance(t, tuple | list) and (t[:1] == ("var",) or any(map(uses_variable, t)))


def from_variable(body, name: str, truth: bool = False) -> bool:
    """Whether a body is a path from the variable, or for truth a comparison of one with a value, and has it and the context item nowhere else."""
    if body == ("var", name):
        return True
    if body[0] == "path" and body[1] == "" and body[2] and body[2][0][1] == ("var", name):
        return not uses_variable([e for _, e in body[2][1:]])
    return truth and body[0] == "compare" and all(from_variable(x, name) or x[0] in ("string", "integer", "decimal", "double") for x in body[2:4])


def with_predicate(path: tuple, p: tuple) -> tuple:
    *before, (sep, last) = path[2]
    return ("path", path[1], [*before, (sep, (*last[:3], [*last[3], p], last[4]))]) if last[0] == "step" else ("postfix", path, [("predicate", p)])


def parts(t):
    """All trees inside a tree."""
    if isinstance(t, tuple | list):
        for x in t:
            if isinstance(x, tuple) and x and isinstance(x[0], str):
                yield x
            yield from parts(x)


def looks_at_position(t) -> bool:
    """Whether position() or last() of this step is read; those inside another step's predicate are of that one."""
    if isinstance(t, list):
        return any(map(looks_at_position, t))
    if not isinstance(t, tuple) or t[:1] in (("path",), ("step",)):
        return False
    if t[:1] == ("call",) and plain_name(t[1]) in ("position", "last"):
        return True
    return any(map(looks_at_position, t))


def needs_last(t: tuple) -> bool:
    return (t[0] == "call" and plain_name(t[1]) == "last") or any(x[0] == "call" and plain_name(x[1]) == "last" for x in parts(t))


def substitute(t, name: str, by: tuple, strict: bool = True, inside: bool = False):
    """The tree with a variable replaced; as the context item it cannot be read inside another predicate."""
    if t == ("var", name):
        if inside and by == ("dot",) and strict:
            raise UnsupportedError(f"${name} inside a predicate has no plan")
        return by
    if isinstance(t, tuple):
        if len(t) == 5 and t[0] == "step":
            return (*t[:3], [substitute(p, name, by, strict, True) for p in t[3]], t[4])
        return tuple(substitute(x, name, by, strict, inside) for x in t)
    if isinstance(t, list):
        return [substitute(x, name, by, strict, inside) for x in t]
    return t
