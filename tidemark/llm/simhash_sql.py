"""SimHash near-duplicates as SQL: XXH64 in unsigned 128-bit arithmetic, bit votes, links by all pairs of fingerprints."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

#: Primes of the published XXH64 specification, and the contract's seed (fixed values).
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
SEED = 42
WORD = 1 << 64


def _n(value: int) -> str:
    return f"{value % WORD}::UHUGEINT"


P1, P2, P3, P4, P5 = map(_n, PRIMES)
MOD = f"{WORD}::UHUGEINT"


def _turn(x: str, bits: int) -> str:
    """``x`` turned left in 64 bits."""
    return f"(({x} * {_n(1 << bits)}) % {MOD} + {x} // {_n(1 << (64 - bits))})"


def _round(acc: str, lane: str) -> str:
    mixed = f"(({acc} + {lane} * {P2}) % {MOD})"
    return f"(({_turn(mixed, 31)} * {P1}) % {MOD})"


def _lane(at: str, width: int) -> str:
    """``width`` bytes of the list ``b`` from the zero-based place ``at``, the lowest first."""
    return "(" + " + ".join(f"b[{at} + {j + 1}] * {_n(256**j)}" for j in range(width)) + ")"


def _lanes(count: str, first: str, step: int) -> str:
    return f"list_transform(range(0, {count}), lambda j: {_lane(f'{first} + {step} * j', 8)})"


_STARTS = (SEED + PRIMES[0] + PRIMES[1], SEED + PRIMES[1], SEED, SEED - PRIMES[0])
_STRIPES = ", ".join(f"list_reduce({_lanes('n // 32', str(8 * k), 32)}, lambda v, l: {_round('v', 'l')}, {_n(start)}) AS v{k}" for k, start in enumerate(_STARTS))
_JOINED = " + ".join(_turn(f"v{k}", bits) for k, bits in enumerate((1, 7, 12, 18)))
_ABSORB = f"(xor(h, {_round(_n(0), 'l')}) * {P1} + {P4}) % {MOD}"
_EIGHT = f"(xor(h, {_round(_n(0), 'l')}))"
_FOUR = f"xor(h, ({_lane('n // 8 * 8', 4)} * {P1}) % {MOD})"
_ONE = f"xor(h, (l * {P5}) % {MOD})"

#: The pairs of fingerprints are compared one with another here; a check of results, not a plan for large tables.
SIMHASH_SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d),
g AS (SELECT r, array_to_string(list_slice(w, i, i + 2), ' ') AS t, count(*) AS c FROM p GROUP BY ALL),
u AS (SELECT t, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::UHUGEINT) AS b, strlen(t) AS n FROM (SELECT DISTINCT t FROM g)),
x1 AS (SELECT t, b, n, {_STRIPES} FROM u),
x2 AS (SELECT t, b, n, (CASE WHEN n < 32 THEN {_n(SEED + PRIMES[4])}
  ELSE list_reduce([v0, v1, v2, v3], lambda h, l: {_ABSORB}, ({_JOINED}) % {MOD}) END + n::UHUGEINT) % {MOD} AS h FROM x1),
x3 AS (SELECT t, b, n, list_reduce({_lanes('n % 32 // 8', 'n // 32 * 32', 8)}, lambda h, l: ({_turn(_EIGHT, 27)} * {P1} + {P4}) % {MOD}, h) AS h FROM x2),
x4 AS (SELECT t, b, n, CASE WHEN n % 8 < 4 THEN h ELSE ({_turn(f'({_FOUR})', 23)} * {P2} + {P3}) % {MOD} END AS h FROM x3),
x5 AS (SELECT t, list_reduce(list_slice(b, n // 4 * 4 + 1, n), lambda h, l: ({_turn(f'({_ONE})', 11)} * {P1}) % {MOD}, h) AS h FROM x4),
x6 AS (SELECT t, (xor(h, h // {_n(1 << 33)}) * {P2}) % {MOD} AS h FROM x5),
x7 AS (SELECT t, (xor(h, h // {_n(1 << 29)}) * {P3}) % {MOD} AS h FROM x6),
x8 AS (SELECT t, xor(h, h // {_n(1 << 32)})::UBIGINT AS h FROM x7),
votes AS (SELECT g.r, bit.place, sum(g.c * ((x8.h >> bit.place::UBIGINT) & 1)) AS ones, sum(g.c) AS n
  FROM g JOIN x8 USING (t) CROSS JOIN (SELECT unnest(range(64)) AS place) bit GROUP BY ALL),
f AS (SELECT r, sum(CASE WHEN 2 * ones > n THEN (1::HUGEINT << place::INTEGER) ELSE 0 END)::UBIGINT AS fp FROM votes GROUP BY r),
named AS (SELECT d.doc_id, coalesce(f.fp, 0)::UBIGINT AS fp FROM d LEFT JOIN f USING (r)),
k AS (SELECT fp, min(doc_id) AS rep FROM named GROUP BY fp),
link AS (SELECT a.fp AS a, b.fp AS b FROM k a JOIN k b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= 2),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least_id AS (SELECT reach.a AS fp, min(k.rep) AS rep FROM reach JOIN k ON reach.b = k.fp GROUP BY reach.a)
SELECT named.doc_id, lpad(lower(to_hex(named.fp)), 16, '0') AS fingerprint, least(k.rep, least_id.rep) AS component_id
FROM named JOIN k USING (fp) LEFT JOIN least_id USING (fp)
"""
