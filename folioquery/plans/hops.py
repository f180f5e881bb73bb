"""``asFile()`` in canonical expressions: every static hop becomes a resolution and a left join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioquery.operators.frame import Records
from folioquery.operators.links import dealt, pick, seat
from folioquery.plans.compiler import Scope, Val, compiler, literal
from folioquery.plans.syntax import Call, ExpressionError, Lit, MapLit, Member, Name, children, rewritten
from folioquery.values import STRING, Kind

#: Functions that name a variable in their first argument.
_BINDERS = ("map", "filter", "all", "exists", "exists_one")

#: Rows with the same link that one task is to join; a link of more rows is dealt in parts.
PART_ROWS = 100_000


def _walk(node):
    yield node
    for c in children(node):
        yield from _walk(c)


class Hops:
    """Lowers the hops of a query's trees. ``df`` grows by one column a hop; rows are neither lost nor multiplied.

    A link is looked up from its record's path, or from the path of the record that an earlier hop led to; a fixed text
    as argument is another source. Options are ``ambiguity`` (``native`` or ``unique``) and ``types``. A link that leads nowhere,
    to several records, or to a path that several records have is null, and so are members of its record;
    under ``unique`` ambiguity is an error of the row. Equal hops of a query are one join.
    Only the fields that some expression names travel. Each link is resolved once for all records of a folder.
    """

    def __init__(self, records: Records, targets: Records, df: DataFrame, trees: list):
        self.records, self.targets, self.df, self._before = records, targets, df, df
        self.bound: dict[str, Val] = {}
        self._done: dict[object, str] = {}
        self._names = {n.name for t in trees for n in _walk(t) if isinstance(n, Member)} | {a.value for t in trees for n in _walk(t) for a in children(n) if isinstance(a, Lit) and isinstance(a.value, str)}

    def lower(self, tree, scope: Scope):
        """The tree with a bound name for each hop."""
        for n in _walk(tree):
            if isinstance(n, Call) and n.name in _BINDERS and n.args and isinstance(n.args[0], Name):
                inner = [x for a in n.args[1:] for x in _walk(a)]
                if any(isinstance(x, Call) and x.name == "asFile" and n.args[0] in _walk(x.target) for x in inner):
                    raise ExpressionError("asFile of a list's elements is not available in expressions", "invalid_query")
        return rewritten(tree, lambda n: self._hop(n, scope) if isinstance(n, Call) and n.name == "asFile" and n.target is not None else n)

    def _hop(self, node: Call, scope: Scope) -> Name:
        if node in self._done:
            return Name(self._done[node])
        name = f"__hop{len(self._done)}"
        self._done[node] = name
        cel = compiler("cel", scope.bind(**self.bound))
        link = cel.concrete(cel.compile(node.target), STRING)
        if link.kind != STRING:
            wrong = None if link.kind.name == "null" else F.lit("expected a link")
            self.bound[name] = Val(F.lit(None), literal(None).kind, link.err if link.err is not None else wrong)
            return Name(name)
        source, unique, types = self._arguments(node)
        later = any(isinstance(n, Name) and (n.id in self.bound or n.id == "projection") for n in _walk(node))
        self._join(name, source, link, unique, types, self.df if later else self._before)
        return Name(name)

    def _arguments(self, node: Call) -> tuple[Column, bool, list[str]]:
        args = list(node.args)
        source = F.lit(args.pop(0).value) if args and isinstance(args[0], Lit) and isinstance(args[0].value, str) else self._origin(node.target)
        unique, types = False, []
        if args and isinstance(args[0], MapLit):
            for k, v in args.pop(0).items:
                key = getattr(k, "value", None)
                if key == "ambiguity" and getattr(v, "value", None) in ("native", "unique"):
                    unique = v.value == "unique"
                elif key == "types" and (found := [getattr(x, "value", None) for x in children(v)]) and all(isinstance(x, str) for x in found):
                    types = [x.lower() for x in found]
                else:
                    raise ExpressionError(f"asFile: unknown option or value of {key!r}")
        if args:
            raise ExpressionError("asFile: expected an optional source path and an options map", "wrong_argument_count")
        return source, unique, types

    def _origin(self, node) -> Column:
        while isinstance(node, Member):
            node = node.target
        hop = self.bound.get(node.id) if isinstance(node, Name) else None
        return self.records.path if hop is None or hop.kind.name != "map" else hop.col["file"]["path"]

    def _join(self, name: str, source: Column, link: Val, unique: bool, types: list[str], over: DataFrame) -> None:
        """``over``: the rows with the columns that the link needs."""
        t, at, raw, part = self.targets, f"{name}_source", f"{name}_link", f"{name}_part"
        linked = over.select(seat(source).alias("source_path"), link.col.alias("raw_target")).where("source_path is not null and raw_target is not null")
        asked = linked.distinct()
        if types:
            asked = asked.withColumn("target_types", F.array(*[F.lit(x) for x in types]))
        named = [t.fields[c].col.cast("string").alias(c) if c in t.fields else F.lit(None).cast("string").alias(c) for c in ("id", "title")]
        # packed files say little of a table's size in memory, so no table of targets or links is broadcast by it
        named = dealt(t.df.select(t.path.alias("path"), *named, F.transform(t.types, F.lower).alias("types")))
        found = pick(asked.hint("merge"), named.hint("merge"), unique=unique)

        facts = {"path": Val(t.path, STRING), **{k: v for k, v in t.file.items() if k in self._names}}
        shown = {k: v for k, v in t.fields.items() if k in self._names and k != "file"}
        record = F.struct(*[v.col.alias(k) for k, v in shown.items()], F.struct(*[v.col.alias(k) for k, v in facts.items()]).alias("file"))
        # a path that several records have leads to none of them
        once = dealt(t.df.select(t.path.alias("__path"), record.alias(name))).groupBy("__path").agg(F.count(F.lit(1)).alias("__n"), F.any_value(name).alias(name)).where("__n = 1").hint("merge")
        # links without a target, which only their ambiguity keeps here, are dealt by their own text
        found = found.where("target_path is not null or why = 'ambiguous'" if unique else "target_path is not null")
        led = found.join(once, (F.coalesce("target_path", "raw_target") == F.col("__path")) & F.col("target_path").isNotNull(), "left" if unique else "inner")
        led = led.select(F.col("source_path").alias(f"{at}_"), F.col("raw_target").alias(f"{raw}_"), name, F.col("why").alias(f"{name}_why"))

        # popular links are few, so they are broadcast; what is no link is dealt by its record's path
        popular = linked.groupBy("source_path", "raw_target").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PART_ROWS)
        popular = F.broadcast(popular.select(F.col("source_path").alias("__at"), F.col("raw_target").alias("__raw"), F.ceil(F.col("__n") / PART_ROWS).alias("__parts")))
        led = led.join(popular, (F.col(f"{at}_") == F.col("__at")) & (F.col(f"{raw}_") == F.col("__raw")), "left")
        led = led.withColumn(f"{part}_", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("__parts") - 1, F.lit(0).cast("long"))))).drop("__at", "__raw", "__parts")
        df = self.df.withColumns({at: seat(source), raw: link.col})
        df = df.join(popular, (F.col(at) == F.col("__at")) & (F.col(raw) == F.col("__raw")), "left")
        own = F.xxhash64(self.records.path)
        df = df.withColumn(part, F.when(F.col(at).isNull() | F.col(raw).isNull(), own).otherwise(F.coalesce(F.pmod(own, F.col("__parts")), F.lit(0).cast("long")))).drop("__at", "__raw", "__parts")
        same = (F.col(at) == F.col(f"{at}_")) & (F.col(raw) == F.col(f"{raw}_")) & (F.col(part) == F.col(f"{part}_"))
        self.df = df.join(led.hint("merge"), same, "left").drop(f"{at}_", f"{raw}_", f"{part}_")

        file_kind = Kind("map", fields=tuple((k, v.kind) for k, v in facts.items()))
        kind = Kind("map", fields=(*((k, v.kind) for k, v in shown.items()), ("file", file_kind)))
        err = F.when(F.col(f"{name}_why") == "ambiguous", F.lit("ambiguous link")) if unique else None
        self.bound[name] = Val(F.col(name), kind, err if link.err is None else link.err if err is None else F.coalesce(link.err, err))
