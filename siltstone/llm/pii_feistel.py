"""Format-preserving pseudonyms for personal data: keyed Feistel permutations within each format.

Everything on the main path is a Spark SQL expression: one regular expression finds candidates,
each is validated (Luhn, mod 97, calendar, ranges), and a valid value is permuted inside the set
of valid values of its kind, so equal values get equal pseudonyms in every document, and two
different values never share one. A map over rows: no shuffle, no state, nothing to skew.

Kinds and their domains
  card    13-19 digits that pass Luhn: all digits but the last are permuted, the last is recomputed
  iban    mod-97 valid: country stays, the account part is permuted by character class, check
          digits are recomputed
  ssn     ddd-dd-dddd in the issued ranges: permuted within them
  date    1900-01-01..2099-12-31 as y-m-d, m/d/y (d/m/y if only that is a date) or d.m.y: the day
          number is permuted, so one day has one pseudonym in every notation
  ip      IPv4: permuted within 32 bits
  phone   the last ten digits are permuted, a country code stays
  email   the local part is permuted by character class, the domain stays
  secret  the value of `token = "..."` and the like, by character class

Separators, lengths, letter case and the text around a value stay. Candidates that fail their
validation, null and empty texts stay as they are. Repeated rows are treated alike; other
columns pass through. Values of one character can map to themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import table

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Candidates by kind, in order of preference. Possessive quantifiers and look-behinds keep the
#: search linear in texts without spaces.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}",
    "secret": r"(?<![A-Za-z0-9_])(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)(?: ?[=:] ?)[\"'][A-Za-z0-9_+/=-]{16,}+[\"']",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
}

#: Alphabets of the character classes; other characters stay in place.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)


@dataclass(frozen=True)
class Params:
    """``key`` is the secret of the permutations: pass a key of your own, since whoever has it can
    undo them. ``rounds`` is even, so both halves are changed equally often."""

    key: str = "siltstone-demo-key"
    rounds: int = 8


def _quote(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class _Sql:
    """SQL text of the permutations, for one key. Arguments are SQL text too."""

    def __init__(self, p: Params) -> None:
        self.p = p

    def prf(self, kind: str, i: str, x: str, size: str) -> str:
        """Hex digits from the keyed hash of round ``i``, ``x`` and a size."""
        return f"sha2(concat_ws('|', {_quote(self.p.key)}, {_quote(kind)}, {i}, {size}, {x}), 256)"

    def pair(self, kind: str, x: str, y: str, mx: int, my: int) -> str:
        """struct(a, b): the permuted pair of 0 <= x < mx and 0 <= y < my, all bigint."""
        f = lambda part, mod: f"pmod(cast(conv(substr({self.prf(kind, 'i', part, str(mod))}, 1, 15), 16, 10) as bigint), {mod}L)"
        even = f"named_struct('a', pmod(h.a + {f('h.b', mx)}, {mx}L), 'b', h.b)"
        odd = f"named_struct('a', h.a, 'b', pmod(h.b + {f('h.a', my)}, {my}L))"
        start = f"named_struct('a', cast({x} as bigint), 'b', cast({y} as bigint))"
        return f"aggregate(sequence(0, {self.p.rounds - 1}), {start}, (h, i) -> if(i % 2 = 0, {even}, {odd}))"

    def _shift(self, half: str, stream: str) -> str:
        """``half`` with every character moved within its class by two hex digits of ``stream``."""
        v = "cast(conv(substr(s, 2 * j - 1, 2), 16, 10) as int)"
        case = " ".join(f"when instr('{a}', substr(t, j, 1)) > 0 then substr('{a}', pmod(instr('{a}', substr(t, j, 1)) - 1 + {v}, {len(a)}) + 1, 1)" for a in ALPHABETS)
        moved = f"array_join(transform(sequence(1, length(t)), j -> case {case} else substr(t, j, 1) end), '')"
        return f"if(length({half}) = 0, '', {_let(half, 't', _let(stream, 's', moved))})"

    def chars(self, kind: str, x: str) -> str:
        """``x`` permuted by character class: a Feistel network over its two halves of text."""

        def stream(other: str, own: str) -> str:
            return f"array_join(transform(sequence(0, length({own}) div 32), k -> {self.prf(kind, 'concat(i, chr(46), k)', other, f'length({own})')}), '')"

        even = f"named_struct('a', {self._shift('h.a', stream('h.b', 'h.a'))}, 'b', h.b)"
        odd = f"named_struct('a', h.a, 'b', {self._shift('h.b', stream('h.a', 'h.b'))})"
        start = "named_struct('a', substr(w, 1, length(w) div 2), 'b', substr(w, length(w) div 2 + 1))"
        run = f"aggregate(sequence(0, {self.p.rounds - 1}), {start}, (h, i) -> if(i % 2 = 0, {even}, {odd}), h -> concat(h.a, h.b))"
        return _let(x, "w", run)

    @staticmethod
    def refill(shape: str, symbols: str, pattern: str = "[^0-9]") -> str:
        """``shape`` with its symbols (what ``pattern`` doesn't match) replaced in order."""
        rank = f"length(regexp_replace(substr(o, 1, j), '{pattern}', ''))"
        return _let(shape, "o", _let(symbols, "z", f"array_join(transform(sequence(1, length(o)), j -> if(regexp_replace(substr(o, j, 1), '{pattern}', '') = '', substr(o, j, 1), substr(z, {rank}, 1))), '')"))


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    """Luhn sum of the digits ``d`` (bound name), the last one counted once."""
    v = f"cast(substr({d}, length({d}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (a, i) -> a + if(i % 2 = 0, {v}, if({v} > 4, 2 * {v} - 9, 2 * {v})))"


def _mod97(s: str) -> str:
    """Mod 97 of a bound IBAN-like string, letters counted as 10..35."""
    at = f"instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({s}, i, 1)) - 1"
    return f"aggregate(sequence(1, length({s})), 0, (a, i) -> pmod(a * if({at} > 9, 100, 10) + {at}, 97))"


def _date(x: str) -> str:
    """struct(d: the date or null, p: positions of year, month and day in x), for a candidate."""
    parts = f"split({x}, '[-/.]')"
    iso = lambda y, m, d: f"try_to_date(concat(element_at(q, {y}), '-', lpad(element_at(q, {m}), 2, '0'), '-', lpad(element_at(q, {d}), 2, '0')), 'yyyy-MM-dd')"
    made = lambda y, m, d: f"named_struct('d', {iso(y, m, d)}, 'p', array({y}, {m}, {d}))"
    return _let(parts, "q", f"case when length(element_at(q, 1)) = 4 then {made(1, 2, 3)} when instr({x}, '.') > 0 or {iso(3, 1, 2)} is null then {made(3, 2, 1)} else {made(3, 1, 2)} end")


FIRST_DAY, DAY_PARTS = "date'1900-01-01'", (17, 4297)  # 17 * 4297 days up to 2099-12-31


def pseudonym_sql(p: Params, x: str = "x") -> str:
    """SQL for struct(kind, out) of a candidate ``x``; kind is null where validation fails."""
    sql = _Sql(p)
    none = f"named_struct('kind', cast(null as string), 'out', {x})"
    done = lambda kind, out: f"named_struct('kind', '{kind}', 'out', {out})"
    is_kind = lambda kind: f"regexp_like({x}, {_quote('^(?:' + PATTERNS[kind] + ')$')})"

    local = f"substring_index({x}, '@', 1)"
    email = done("email", f"concat({sql.chars('email', local)}, substr({x}, length({local}) + 1))")

    head = f"regexp_extract({x}, {_quote('^[^' + chr(34) + chr(39) + ']*[' + chr(34) + chr(39) + ']')}, 0)"
    value = f"substr({x}, length({head}) + 1, length({x}) - length({head}) - 1)"
    secret = done("secret", f"concat({head}, {sql.chars('secret', value)}, substr({x}, length({x})))")

    plain = f"replace({x}, ' ', '')"
    turned = _let(f"concat(substr({plain}, 5), substr({plain}, 1, 4))", "u", _mod97("u"))
    account = sql.chars("iban", f"substr({plain}, 5)")
    check = _let(f"concat(n, substr({plain}, 1, 2), '00')", "u", f"lpad(cast(98 - {_mod97('u')} as string), 2, '0')")
    new = _let(account, "n", f"concat(substr({plain}, 1, 2), {check}, n)")
    iban = f"if({turned} = 1, {done('iban', sql.refill(x, new, '[^0-9A-Z]'))}, {none})"

    octet = lambda i: f"cast(element_at(split({x}, '[.]'), {i}) as bigint)"
    half = lambda v: f"concat({v} div 256, '.', {v} % 256)"
    ip = done("ip", _let(sql.pair("ip", f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", 65536, 65536), "g", f"concat({half('g.a')}, '.', {half('g.b')})"))

    a, b = DAY_PARTS
    day = f"cast(datediff(c.d, {FIRST_DAY}) as bigint)"
    moved = _let(sql.pair("date", f"{day} div {b}", f"{day} % {b}", a, b), "g", f"date_add({FIRST_DAY}, cast(g.a * {b} + g.b as int))")
    field = lambda i, fmt: f"if(length(element_at(split({x}, '[-/.]'), {i})) = 1, cast({fmt} as string), lpad(cast({fmt} as string), 2, '0'))"
    sep = f"regexp_extract({x}, '[-/.]', 0)"
    write = f"case when element_at(c.p, 1) = 1 then date_format(e, 'yyyy-MM-dd') when element_at(c.p, 2) = 1 then concat({field(1, 'month(e)')}, {sep}, {field(2, 'day(e)')}, {sep}, lpad(cast(year(e) as string), 4, '0')) else concat({field(1, 'day(e)')}, {sep}, {field(2, 'month(e)')}, {sep}, lpad(cast(year(e) as string), 4, '0')) end"
    date = _let(_date(x), "c", f"if(c.d is not null and year(c.d) between 1900 and 2099, {done('date', _let(moved, 'e', write))}, {none})")

    area, group, serial = (f"cast(element_at(split({x}, '-'), {i}) as int)" for i in (1, 2, 3))
    good = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    index = f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1"
    number = "g.a div 99 + 1 + if(g.a div 99 >= 665, 1, 0)"
    pad = lambda v, n: f"lpad(cast({v} as string), {n}, '0')"
    ssn = f"if({good}, {done('ssn', _let(sql.pair('ssn', index, f'{serial} - 1', 898 * 99, 9999), 'g', f'concat_ws(chr(45), {pad(number, 3)}, {pad('g.a % 99 + 1', 2)}, {pad('g.b + 1', 4)})'))}, {none})"

    permuted = _let(_digits(x), "y", f"concat(substr(y, 1, greatest(length(y) - 10, 0)), {sql.chars('phone', 'right(y, 10)')})")
    phone = f"if(length({_digits(x)}) between 8 and 15, {done('phone', sql.refill(x, permuted))}, {none})"

    digits = _let(_digits(x), "y", _let(sql.chars("card", "substr(y, 1, length(y) - 1)"), "n", _let("concat(n, '0')", "u", f"concat(n, cast(pmod(10 - {_luhn('u')}, 10) as string))")))
    card = f"if({_let(_digits(x), 'u', _luhn('u'))} % 10 = 0, {done('card', sql.refill(x, digits))}, {none})"

    made = {"email": email, "secret": secret, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}
    return "case " + " ".join(f"when {is_kind(k)} then {made[k]}" for k in PATTERNS) + f" else {none} end"


def candidates(text: Column | str) -> Column:
    return F.regexp_extract_all(text, F.lit("|".join(PATTERNS.values())), F.lit(0))


def pseudonymise(docs: DataFrame, p: Params = Params()) -> DataFrame:
    """All rows and columns; text has pseudonyms, `_pseudonyms` lists (kind, out) of the values
    replaced, in order."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = docs.select(*columns, F.coalesce(candidates("text"), F.array().cast("array<string>")).alias("_found"))
    priced = found.select(*columns, F.expr(f"transform(_found, x -> {pseudonym_sql(p)})").alias("_made"))
    between = F.split("text", "|".join(PATTERNS.values()), -1)
    parts = F.zip_with(between, F.transform("_made", lambda m: m["out"]), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.exists("_made", lambda m: m["kind"].isNotNull()), F.array_join(parts, "")).otherwise(F.col("text"))
    return priced.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.filter("_made", lambda m: m["kind"].isNotNull()).alias("_pseudonyms"),
    )


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id",
        "text",
        F.size("_pseudonyms").cast("long").alias("n_pseudonyms"),
        F.array_join(F.transform("_pseudonyms", lambda m: m["kind"]), ",").alias("kinds"),
        F.array_join(F.transform("_pseudonyms", lambda m: m["out"]), "\n").alias("pseudonyms"),
    )


def hide_pii(spark: SparkSession, docs: DataFrame, sf_dir: str, p: Params = Params()) -> DataFrame:
    """Pipeline stage: every document stays, with pseudonyms in its text."""
    return pseudonymise(docs, p).select(*[F.col(f"`{c}`") for c in docs.columns])
