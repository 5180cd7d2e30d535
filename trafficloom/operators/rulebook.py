"""First matching route of any number of mixed rules.

Rules are rows. Each is read once, in a task, to a program over its conditions, the atoms, and to anchors: atoms
one of which is true wherever the rule holds. Hosts, methods, path prefixes and networks are facts of a request,
a pattern is tried where the request begins with the pattern's literal beginning. One join gives each distinct
request its set of true atoms, another the rules that are anchored in a set; those alone are tried, and the
first that holds is kept. So neither the plan nor a task nor the driver holds all rules, and a request doesn't
meet rules that share nothing with it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import header_first
from ..functions.predicates import Spec, check_leaf, ipv4_number, ipv6_groups, parse_network, predicate
from ..sources.scratch import scratch
from ..workers import prepare
from .joins import small

ANY = "*"  # the anchor of rules that may hold where none of their atoms is true
NATIVE = ("Host", "Method", "PathStartsWith", "RemoteAddr", "RegexPath")
STEP = "op string, n int, atoms array<string>"
COMPILED = f"route_id string, ordinal {{0}}, program array<struct<{STEP}>>, anchors array<string>, looked array<struct<fact string, atom string, pattern string>>, own array<string>"


def tree_of(spec: Spec | None, where: str = "rule") -> tuple:
    """("atom", name, properties), ("and" or "or", trees), ("not", tree), as predicates.condition reads a rule: lists and maps hold together, empty ones are true."""
    if spec is None:
        return "and", []
    if isinstance(spec, Mapping):
        parts = []
        for name, body in spec.items():
            at = f"{where}.{name}"
            if name in ("and", "or"):
                if body:
                    inner = [{k: v} for k, v in body.items()] if isinstance(body, Mapping) else body
                    parts.append((name, [tree_of(x, f"{at}[{i}]") for i, x in enumerate(inner)]))
            elif name == "not":
                parts.append(("not", tree_of(body, at)))
            elif isinstance(body, Mapping):
                if name in NATIVE:
                    check_leaf(name, body, at)
                parts.append(("atom", name, body))
            else:
                raise ValueError(f"{at}: expected the predicate's properties, got {body!r}")
        return "and", parts
    if isinstance(spec, Sequence) and not isinstance(spec, str):
        return "and", [tree_of(x, f"{where}[{i}]") for i, x in enumerate(spec)]
    raise ValueError(f"{where}: expected a list or map, got {spec!r}")


def literal_beginning(regexp: str) -> str:
    """Text that every path which matches the whole pattern begins with; as long as plain characters go."""
    if "|" in regexp:
        return ""
    plain = re.match(r"[A-Za-z0-9/_\- ]*", regexp).group()
    return plain[:-1] if regexp[len(plain): len(plain) + 1] in ("?", "*", "{") and plain else plain


def _atom(name: str, body: Mapping) -> tuple[list[str], list[tuple[str, str, str | None]], str | None]:
    """(texts any of which makes the atom true, facts to look for, the atom itself where a Column decides it)."""
    if name == "Host":
        found = [f"H:{h.lower()}" for h in body["hosts"]]
    elif name == "Method":
        found = [f"M:{m}" for m in body["include"]]
    elif name == "PathStartsWith":
        found = [f"P:{body['prefix']}"]
    elif name == "RemoteAddr":
        net = parse_network(body["source"])
        number, bits = int(net.network_address), net.prefixlen
        found = [f"4:{bits}:{number >> 32 - bits}" if net.version == 4 else f"6:{bits}:{number:0128b}"[: len(f"6:{bits}:") + bits]]
    elif name == "RegexPath":
        own = f"R:{body['regexp']}"
        return [own], [(f"P:{literal_beginning(body['regexp'])}", own, rf"\A(?:{body['regexp']})\z")], None
    else:
        own = "C:" + json.dumps([name, body], sort_keys=True)
        return [own], [], own
    return found, [(x, x, None) for x in found], None


def _rank(anchors: frozenset) -> tuple:
    """Smaller for anchors that fewer requests have: a long prefix or pattern, then networks, hosts, methods."""
    def weight(text: str) -> int:
        kind, rest = text[0], text[2:]
        return len(rest) if kind == "P" else len(literal_beginning(rest)) if kind == "R" else int(rest.split(":")[0]) // 8 if kind in "46" else {"H": 2, "M": 1}.get(kind, 0)

    return (-min(map(weight, anchors), default=1 << 20), len(anchors))


def compiled(spec: Spec | None, where: str = "rule") -> tuple[list[tuple], list[str], list[tuple], list[str]]:
    """(program in postfix order, anchors, facts to look for, atoms that Columns decide) of a rule."""
    program, looked, own = [], {}, []

    def walk(tree: tuple, negated: bool) -> frozenset:
        """Anchors of the tree, or of its negation: {ANY} where it may hold without a true atom."""
        if tree[0] == "atom":
            texts, facts, column = _atom(*tree[1:])
            program.append(("atom", len(texts), texts))
            looked.update(dict.fromkeys(facts))
            own.extend([column] if column else [])
            return frozenset([ANY]) if negated else frozenset(texts)
        if tree[0] == "not":
            found = walk(tree[1], not negated)
            program.append(("not", 1, []))
            return found
        parts = [walk(x, negated) for x in tree[1]]
        program.append((tree[0], len(parts), []))
        if (tree[0] == "and") != negated:  # all parts hold: the best of them will do
            return min([x for x in parts if ANY not in x], key=_rank, default=frozenset([ANY]))
        return frozenset([ANY]) if any(ANY in x for x in parts) else frozenset().union(*parts)

    anchors = walk(tree_of(spec, where), False)
    return program, sorted(anchors), list(looked), own


def _holds(atoms: Column, program: Column) -> Column:
    """The program's value where `atoms` are the true ones: a stack of truth values."""
    def step(stack: Column, x: Column) -> Column:
        below = F.slice(stack, F.lit(1), F.size(stack) - x["n"])
        top = F.slice(stack, F.size(stack) - x["n"] + 1, x["n"])
        value = (
            F.when(x["op"] == "atom", F.arrays_overlap(atoms, x["atoms"])).when(x["op"] == "not", ~F.element_at(stack, -1))
            .when(x["op"] == "and", ~F.array_contains(top, False)).otherwise(F.array_contains(top, True))
        )
        return F.concat(F.when(x["op"] == "atom", stack).otherwise(below), F.array(value))

    return F.element_at(F.aggregate(program, F.expr("cast(array() as array<boolean>)"), step), -1)


def _request_facts(prefixes: Sequence[int], networks: Sequence[tuple[str, int]]) -> Column:
    """The facts of a request (_host, _method, _path, _ip): host, method, beginnings of these lengths, networks of these families and bits."""
    made = [F.concat(F.lit("H:"), F.col("_host")), F.concat(F.lit("M:"), F.col("_method"))]
    for n in prefixes:
        made.append(F.when(F.length("_path") >= n, F.concat(F.lit("P:"), F.substring("_path", 1, n))))
    v4 = ipv4_number(F.col("_ip"))
    bits6 = F.array_join(F.transform(F.split(ipv6_groups(F.col("_ip")), ""), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0")), "")
    for family, bits in networks:
        masked = F.shiftright(v4, 32 - int(bits)).cast("string") if family == "4" else F.substring(bits6, 1, int(bits))
        made.append(F.when((v4 if family == "4" else ipv6_groups(F.col("_ip"))).isNotNull(), F.concat(F.lit(f"{family}:{bits}:"), masked)))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def assign_by_rules(requests: DataFrame, routes: Sequence[tuple[str, Spec | None]] | DataFrame, column: str = "route_id") -> DataFrame:
    """requests with the first matching route in list order, NULL if there is none; as joins.assign_route, for long mixed rule lists.

    routes is a list, or a table (ordinal, route_id, rule as JSON) of any length whose ordinals, of any type that can
    be compared, are different. requests have headers, method, path and client_ip, and what other registered predicates
    read; predicates that were registered beside the five of the library are read to the driver, one of each kind.
    """
    spark = requests.sparkSession
    prepare(spark)
    if not isinstance(routes, DataFrame):
        for i, (_, rule) in enumerate(routes):
            for name, body in (json.loads(x[2:]) for x in compiled(rule, f"routes[{i}]")[3]):
                check_leaf(name, body, f"routes[{i}]")
        rows = [(i, name, json.dumps(rule)) for i, (name, rule) in enumerate(routes)]
        routes = spark.createDataFrame(rows, "ordinal long, route_id string, rule string")
    schema = COMPILED.format(routes.schema["ordinal"].dataType.simpleString())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [compiled(json.loads(rule) if rule else None, f"rule of {name}") for name, rule in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            arrays = [
                pa.array([[dict(zip(("op", "n", "atoms"), x)) for x in m[0]] for m in made], pa.list_(pa.struct([("op", pa.string()), ("n", pa.int32()), ("atoms", pa.list_(pa.string()))]))),
                pa.array([m[1] for m in made], pa.list_(pa.string())),
                pa.array([[dict(zip(("fact", "atom", "pattern"), x)) for x in m[2]] for m in made], pa.list_(pa.struct([(n, pa.string()) for n in ("fact", "atom", "pattern")]))),
                pa.array([m[3] for m in made], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["route_id", "ordinal", "program", "anchors", "looked", "own"])

    path = scratch(spark, "rules")
    routes.select("route_id", "ordinal", "rule").mapInArrow(read, schema).write.parquet(path)
    rules = spark.read.schema(schema).parquet(path)
    looked = rules.select(F.explode("looked").alias("x")).select("x.*").distinct()
    kinds = looked.select(F.substring("fact", 1, 1).alias("kind"), F.when(F.col("fact").startswith("P"), F.length("fact") - 2).otherwise(F.get(F.split("fact", ":"), F.lit(1)).try_cast("int")).alias("size"))
    sizes = sorted((r.kind, r["size"]) for r in kinds.where("kind in ('P', '4', '6')").distinct().collect())  # as many as there are lengths
    keys = [r.key for r in rules.select(F.explode("own").alias("key")).distinct().collect()]
    others = [(key, predicate(name, **body)) for key in keys for name, body in [json.loads(key[2:])]]

    as_columns = F.filter(F.array(*[F.when(c, F.lit(key)) for key, c in others]), lambda x: x.isNotNull()) if others else F.expr("cast(array() as array<string>)")
    host = F.lower(F.get(F.split(header_first("headers", "Host"), ":"), F.lit(0)))
    signature = F.struct(host.alias("_host"), F.col("method").alias("_method"), F.col("path").alias("_path"), F.col("client_ip").alias("_ip"), as_columns.alias("_own"))
    marked = requests.withColumn("_signature", signature)
    facts = _request_facts([n for kind, n in sizes if kind == "P"], [(kind, n) for kind, n in sizes if kind != "P"])
    distinct = marked.select("_signature").distinct()
    each = distinct.select("_signature", "_signature.*").select("_signature", "_path", F.explode(facts).alias("fact"))
    known = each.join(small(looked), "fact").where(F.col("pattern").isNull() | F.expr("coalesce(regexp_like(_path, pattern), false)"))
    # what a request shares with no rule is left out of its set; a request of which nothing is left keeps an empty one
    whole = known.select("_signature", "atom").unionByName(distinct.select("_signature", F.lit(None).cast("string").alias("atom")))
    sets = whole.groupBy("_signature").agg(F.collect_set("atom").alias("_atoms")).select("_signature", F.array_sort(F.concat("_atoms", "_signature._own")).alias("_atoms"))
    anchors = rules.select("route_id", "ordinal", "program", F.explode("anchors").alias("anchor"))
    kinds = [r.kind for r in anchors.select(F.substring("anchor", 1, 1).alias("kind")).distinct().collect()]  # seven at most; hosts and methods that anchor nothing are not dealt
    likely = F.filter(F.concat("_atoms", F.array(F.lit(ANY))), lambda x: F.substring(x, 1, 1).isin(kinds))
    anchored = sets.select("_atoms").distinct().select("_atoms", F.explode(likely).alias("anchor"))
    tried = anchored.join(small(anchors), "anchor").where(_holds(F.col("_atoms"), F.col("program")))
    decided = tried.groupBy("_atoms").agg(F.min_by("route_id", "ordinal").alias("_route"))
    of_signature = sets.join(decided, "_atoms").select(F.col("_signature").alias("_key"), "_route")
    found = marked.join(of_signature, F.col("_signature") == F.col("_key"), "left")
    return found.select(*[F.col(f"`{c}`") for c in requests.columns if c != column], F.col("_route").alias(column))
