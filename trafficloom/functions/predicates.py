"""Request predicates as Columns, and conditions built from nested dicts and lists."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exchange import IPV4, IPV6, col
from .headers import header_first

Spec = Mapping | Sequence


def two_valued(c: Column) -> Column:
    """NULL counts as false, so a negation has two values as well."""
    return F.coalesce(c, F.lit(False))


def host(hosts: Sequence[str], column: Column | str | None = None) -> Column:
    """The request's host is listed; port and case don't matter."""
    c = header_first("headers", "Host") if column is None else col(column)
    return two_valued(F.lower(F.get(F.split(c, ":"), F.lit(0))).isin([h.lower() for h in hosts]))


def method(include: Sequence[str], column: Column | str = "method") -> Column:
    return two_valued(col(column).isin(list(include)))


def path_starts_with(prefix: str, column: Column | str = "path") -> Column:
    return two_valued(col(column).startswith(prefix))


def regex_path(regexp: str, column: Column | str = "path") -> Column:
    """The whole path matches."""
    return two_valued(col(column).rlike(rf"\A(?:{regexp})\z"))


def ipv4_number(text: Column) -> Column:
    parts = F.split(text, r"\.")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(text.rlike(IPV4), ((n(0) * 256 + n(1)) * 256 + n(2)) * 256 + n(3))


def ipv6_groups(text: Column) -> Column:
    """The eight groups of an address as hexadecimal, zero-filled; NULL if it isn't one."""
    sides = F.split(F.lower(text), "::", 2)
    groups = lambda s: F.filter(F.split(F.coalesce(s, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    missing = F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))
    full = F.concat(left, F.array_repeat(F.lit("0"), missing), right)
    return F.when(text.rlike(IPV6), F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def parse_network(source: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
    """An address or CIDR; trailing IPv4 parts may be missing (192.168.1/24). ValueError if malformed."""
    address, slash, bits = source.strip().partition("/")
    if "." in address and ":" not in address:
        address = ".".join([*address.strip(".").split("."), "0", "0", "0"][:4])
    elif address.isdigit() and slash:
        address = f"{address}.0.0.0"
    return ipaddress.ip_network(address + slash + bits, strict=False)


def remote_addr(source: str, column: Column | str = "client_ip") -> Column:
    """The address lies in an IP or CIDR; another family or NULL doesn't."""
    net = parse_network(source)
    c = col(column)
    if net.version == 4:
        return two_valued(ipv4_number(c).between(int(net.network_address), int(net.broadcast_address)))
    low, high = f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"
    return two_valued(ipv6_groups(c).between(low, high))  # equal lengths: text order is number order


_REGISTRY: dict[str, tuple[Callable[..., Column], frozenset[str]]] = {}


def register_predicate(name: str, fn: Callable[..., Column], properties: Sequence[str]) -> None:
    """Make a predicate known to `condition`. A name can be taken once."""
    if name in _REGISTRY:
        raise ValueError(f"predicate {name!r} is registered already")
    _REGISTRY[name] = (fn, frozenset(properties))


register_predicate("Host", host, ("hosts",))
register_predicate("Method", method, ("include",))
register_predicate("PathStartsWith", path_starts_with, ("prefix",))
register_predicate("RegexPath", regex_path, ("regexp",))
register_predicate("RemoteAddr", remote_addr, ("source",))


def predicate(name: str, **config) -> Column:
    return _leaf(name, config, name)


def check_leaf(name: str, config: Mapping, where: str) -> Callable[..., Column]:
    """The predicate's function; ValueError if its name or a property is unknown, or one is missing."""
    if name not in _REGISTRY:
        raise ValueError(f"{where}: unknown predicate {name!r}; known: {', '.join(sorted(_REGISTRY))}")
    fn, known = _REGISTRY[name]
    if unknown := set(config) - known:
        raise ValueError(f"{where}: unknown property {sorted(unknown)} of {name}; known: {sorted(known)}")
    if missing := known - set(config):
        raise ValueError(f"{where}: {name} lacks {sorted(missing)}")
    return fn


def _leaf(name: str, config: Mapping, where: str) -> Column:
    return check_leaf(name, config, where)(**config)


def condition(spec: Spec | None, where: str = "condition") -> Column:
    """One Column from nested lists (all must hold) and maps (leaves, `and`, `or`, `not`).

    Empty is true; an empty `and` or `or` is left out, so it is true as well. Unknown names and
    properties raise ValueError with their place, before anything runs.
    """
    if spec is None:
        return F.lit(True)
    if isinstance(spec, Mapping):
        parts = []
        for name, body in spec.items():
            at = f"{where}.{name}"
            if name in ("and", "or"):
                if body:
                    made = [condition(x, f"{at}[{i}]") for i, x in enumerate(body if not isinstance(body, Mapping) else [{k: v} for k, v in body.items()])]
                    parts.append(reduce(Column.__and__ if name == "and" else Column.__or__, made))
            elif name == "not":
                parts.append(~condition(body, at))
            elif isinstance(body, Mapping):
                parts.append(_leaf(name, body, at))
            else:
                raise ValueError(f"{at}: expected the predicate's properties, got {body!r}")
        return reduce(Column.__and__, parts) if parts else F.lit(True)
    if isinstance(spec, Sequence) and not isinstance(spec, str):
        return reduce(Column.__and__, [condition(x, f"{where}[{i}]") for i, x in enumerate(spec)]) if spec else F.lit(True)
    raise ValueError(f"{where}: expected a list or map, got {spec!r}")
