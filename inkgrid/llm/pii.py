"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Values are found by pattern, validated by kind, and mapped by keyed Feistel networks that permute the
values of a format: a card number becomes a card number with as valid a check digit, a date a date in the
same notation. Equal values have equal pseudonyms in all documents and different values different ones, so records
stay linked; who has the key can turn the mapping back. The key is the session's setting KEY_CONF. Plans don't hold it: expressions read
it from a column that a scalar subquery over one row fills, and Spark shows neither that row nor, as the setting's name has "secret" in it, the setting.
"""

from __future__ import annotations

import secrets
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

#: Spark setting that holds the key. Set it to the same secret value to link the pseudonyms of several runs.
KEY_CONF = "spark.inkgrid.pii.secret"
ROUNDS = 8
#: Days from 1900-01-01 that dates are permuted among, as two factors: the two sides of their Feistel network.
DAYS = (292, 250)
FIRST_DAY = "1900-01-01"
#: Steps at most of a walk among days over 12: so many in a row that all miss have a probability below 1e-25.
WALK = 64

_WORD = r"[\p{L}\p{N}._%+-]"
#: One to eight parts of an IPv6 address; :: stands for what is left out.
_HEX = "[0-9A-Fa-f]{1,4}"
#: What the issuers' access keys begin with.
ISSUED = "AKIA|ASIA|sk-(?:proj-)?|gh[opsur]_"
#: Kinds in order of precedence. Each pattern is anchored at both ends so that it takes whole values only.
PATTERNS = {
    "email": rf"(?<!{_WORD}){_WORD}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)*\.\p{{L}}{{2,}}+",
    "secret": r"(?<![\p{L}\p{N}])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+)(?![\p{L}\p{N}])",
    "access_key": rf"(?<![\p{{L}}\p{{N}}])(?:{ISSUED})[A-Za-z0-9]{{16,128}}+(?![\p{{L}}\p{{N}}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "date": r"(?<![\p{L}\p{N}./-])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![\p{L}\p{N}/-]|\.[0-9])",
    "ip": r"(?<![\p{L}\p{N}.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\p{L}\p{N}]|\.[0-9])",
    "ipv6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|{_HEX}(?::{_HEX}){{0,5}}::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\p{{L}}\p{{N}}:])",
    "ssn": r"(?<![\p{L}\p{N}-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3} [0-9]{2} [0-9]{4})(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})(?![\p{L}\p{N}])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}|[2-9][0-9]{2} [0-9]{3} [0-9]{4}|0[0-9]{2,4}[ /-][0-9]{3,4}[ -]?[0-9]{3,4}|0[0-9](?:[ .][0-9]{2}){4})(?![\p{L}\p{N}])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No pattern matches without one of these characters: a cheap test first.
HINT = f"[0-9@]|{ISSUED}"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _number(stream: str, at: str) -> str:
    """SQL for 28 bits, the at-th of the stream's seven-digit parts, from a SHA-256 keyed by the stream."""
    return f"cast(conv(substr(sha2({stream}, 256), 1 + 7 * ({at}), 7), 16, 10) AS bigint)"


@cache
def _key_of(application: str) -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key of KEY_CONF; where none is set, a random one that lasts as long as the application, so that values stay linked
    within it and nobody can turn its pseudonyms back afterwards."""
    return spark.conf.get(KEY_CONF, None) or _key_of(spark.sparkContext.applicationId)


def _shift(c: str, n: str, letters: int) -> str:
    """SQL: move a digit within the digits, a letter within its case's first letters, and any character beyond ASCII within
    the sixteen code points that differ in the last hexadecimal digit, which are of one script; ASCII marks stay, and so do
    the signs of multiplication and division, which stand between letters: those move among the other fifteen."""
    place = f"(ascii({c}) % 16 - CASE WHEN ascii({c}) % 16 > 7 THEN 1 ELSE 0 END + {n}) % 15"
    latin = f"WHEN ascii({c}) div 16 IN (13, 15) THEN CASE WHEN ascii({c}) % 16 = 7 THEN {c} ELSE {_let(place, 'q', f'char(ascii({c}) div 16 * 16 + q + CASE WHEN q >= 7 THEN 1 ELSE 0 END)')} END"
    beyond = f"WHEN ascii({c}) > 127 THEN decode(unhex(lpad(hex(ascii({c}) div 16 * 16 + (ascii({c}) + {n}) % 16), 8, '0')), 'UTF-32')"
    moved = [f"WHEN {c} BETWEEN '{chr(lo)}' AND '{chr(lo + size - 1)}' THEN char({lo} + (ascii({c}) - {lo} + {n}) % {size})" for lo, size in ((48, 10), (97, letters), (65, letters))]
    return f"CASE {' '.join(moved)} {latin} {beyond} ELSE {c} END"


def _permute(value: str, key: str, kind: str, letters: int = 26) -> str:
    """SQL: a Feistel network over the characters of value: its halves move each other within each character's class."""
    side = lambda one, other, k: f"transform(s.{one}, (c, i) -> {_shift('c', _number(f'''concat({key}, '|{kind}|', {k}, '|', i div 9, '|', array_join(s.{other}, ''))''', 'i % 9'), letters)})"
    chars = f"filter(split({value}, ''), c -> c <> '')"
    start = f"transform(array({chars}), x -> named_struct('l', slice(x, 1, size(x) div 2), 'r', slice(x, size(x) div 2 + 1, size(x))))[0]"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, k) -> CASE WHEN k % 2 = 1 THEN named_struct('l', {side('l', 'r', 'k')}, 'r', s.r) ELSE named_struct('l', s.l, 'r', {side('r', 'l', 'k')}) END, s -> array_join(concat(s.l, s.r), ''))"


def _permute_number(value: str, key: str, kind: str, a: int, b: int) -> str:
    """SQL: a Feistel network over the numbers below a * b, split as quotient and remainder of b."""
    f = lambda other: _number(f"concat({key}, '|{kind}|', k, '|', s.{other})", "0")
    start = f"named_struct('l', cast({value} AS bigint) div {b}, 'r', cast({value} AS bigint) % {b})"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, k) -> CASE WHEN k % 2 = 1 THEN named_struct('l', (s.l + {f('r')}) % {a}, 'r', s.r) ELSE named_struct('l', s.l, 'r', (s.r + {f('l')}) % {b}) END, s -> s.l * {b} + s.r)"


def _luhn(digits: str) -> str:
    """SQL: what a string of digits adds to a Luhn sum when a check digit follows, modulo 10."""
    doubled = "CASE WHEN i % 2 = 0 THEN 2 * cast(c AS int) - CASE WHEN c >= '5' THEN 9 ELSE 0 END ELSE cast(c AS int) END"
    return f"aggregate(transform(filter(split(reverse({digits}), ''), c -> c <> ''), (c, i) -> {doubled}), 0, (n, x) -> n + x) % 10"


def _refill(value: str, chars: str, wanted: str) -> str:
    """SQL: value with its wanted characters replaced by those of chars, in order."""
    return f"aggregate(filter(split({value}, ''), c -> c <> ''), named_struct('t', '', 'i', 1), (s, c) -> CASE WHEN c RLIKE '{wanted}' THEN named_struct('t', concat(s.t, substr({chars}, s.i, 1)), 'i', s.i + 1) ELSE named_struct('t', concat(s.t, c), 'i', s.i) END, s -> s.t)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value, so that value is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _card(key: str) -> str:
    """All digits but the last are permuted, and the check digit follows; what has a wrong check digit is no card and stays."""
    body = _let(_permute("h", key, "card"), "g", f"concat(g, (10 - {_luhn('g')}) % 10)")
    new = _let("substr(d, 1, length(d) - 1)", "h", f"CASE WHEN (cast(substr(d, -1) AS int) + {_luhn('h')}) % 10 = 0 THEN {_let(body, 'e', _refill('v', 'e', '[0-9]'))} ELSE v END")
    return _let("regexp_replace(v, '[^0-9]', '')", "d", new)


def _iban_rest(text: str) -> str:
    """SQL: the number that letters and digits stand for (A is 10), modulo 97."""
    return f"aggregate(filter(split({text}, ''), c -> c <> ''), 0, (n, c) -> CASE WHEN c <= '9' THEN (n * 10 + cast(c AS int)) % 97 ELSE (n * 100 + ascii(c) - 55) % 97 END)"


def _iban(key: str) -> str:
    """The part after the check digits is permuted, and the check digits follow; others than valid ones stay."""
    new = _let(_permute("substr(d, 5)", key, "iban"), "g", _let(f"98 - {_iban_rest('''concat(g, substr(d, 1, 2), '00')''')}", "k", "concat(substr(d, 1, 2), lpad(cast(k AS string), 2, '0'), g)"))
    return _let("replace(v, ' ', '')", "d", f"CASE WHEN {_iban_rest('concat(substr(d, 5), substr(d, 1, 4))')} = 1 THEN {_let(new, 'e', _refill('v', 'e', '[0-9A-Z]'))} ELSE v END")


def _ip(key: str) -> str:
    """Four octets as one 32-bit number; what has a larger part than 255 is no address and stays."""
    octets = "transform(split(v, '[.]'), x -> cast(x AS bigint))"
    number = "((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]"
    back = "concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256)"
    return _let(octets, "o", f"CASE WHEN exists(o, x -> x > 255) THEN v ELSE {_let(_permute_number(number, key, 'ip', 65536, 65536), 'n', back)} END")


def _date(key: str) -> str:
    """Days from 1900 to 2099 are permuted; what is no such day stays. A slash is read as month/day/year, as day/month/year
    where that is impossible, and as year/month/day where the year stands first. The latter have days over 12 and are permuted among such days, so that they stay in their notation.
    A part keeps its leading zero, and has none where another part has one digit without it."""
    a, b = DAYS
    parts = "split(v, '[-./]')"
    # What is read as (year, month, day), and the same places for writing.
    order = "CASE WHEN length(p[0]) = 4 THEN array(0, 1, 2) WHEN v LIKE '%.%' OR (cast(p[0] AS int) > 12 AND cast(p[1] AS int) <= 12) THEN array(2, 1, 0) ELSE array(2, 0, 1) END"
    day = f"datediff(to_date(try_to_timestamp(concat_ws('-', p[o[0]], lpad(p[o[1]], 2, '0'), lpad(p[o[2]], 2, '0')), 'yyyy-MM-dd')), date'{FIRST_DAY}')"
    moved = f"cast({_permute_number('x', key, 'date', a, b)} AS int)"
    on = lambda n: f"date_add(date'{FIRST_DAY}', cast({n} AS int))"
    # Steps on until the day is over 12, as three of five are: the permutation's own order among those days.
    step = f"named_struct('x', y, 'done', dayofmonth({on('y')}) > 12)"
    walk = f"aggregate(sequence(1, {WALK}), named_struct('x', cast(d AS int), 'done', false), (w, i) -> CASE WHEN w.done THEN w ELSE {_let('w.x', 'x', _let(moved, 'y', step))} END, w -> w.x)"
    new = f"CASE WHEN v LIKE '%/%' AND o[2] = 0 THEN {walk} ELSE {_let('d', 'x', moved)} END"
    bare = "exists(p, x -> length(x) = 1)"
    two = lambda n, k: f"CASE WHEN {bare} AND NOT p[o[{k}]] LIKE '0%' THEN cast({n} AS string) ELSE lpad({n}, 2, '0') END"
    made = _let(on("n"), "t", f"array(lpad(year(t), 4, '0'), {two('month(t)', 1)}, {two('day(t)', 2)})")
    mark = "CASE WHEN v LIKE '%-%' THEN '-' WHEN v LIKE '%.%' THEN '.' ELSE '/' END"
    back = _let(made, "m", f"array_join(transform(array(0, 1, 2), i -> m[cast(array_position(o, i) AS int) - 1]), {mark})")
    return _let(parts, "p", _let(order, "o", _let(day, "d", f"CASE WHEN d BETWEEN 0 AND {a * b - 1} THEN {_let(new, 'n', back)} ELSE v END")))


def _email(key: str) -> str:
    """The domain's last two labels stay; the rest is permuted character by character."""
    return _let("regexp_extract(v, '[^.@]+[.][^.@]+$', 0)", "t", f"concat({_permute('substr(v, 1, length(v) - length(t))', key, 'email')}, t)")


#: Calling codes of one and two digits; all others have three.
CALLING_CODE = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"


def _phone(key: str) -> str:
    """The country code or a first 0 stays, and the notation; all other digits are permuted together, however they are grouped."""
    rest = _let("regexp_replace(substr(v, length(p) + 1), '[^0-9]', '')", "d", _let(_permute("d", key, "phone"), "e", _refill("substr(v, length(p) + 1)", "e", "[0-9]")))
    return _let(f"regexp_extract(v, '^(?:[+](?:{CALLING_CODE})|0)', 0)", "p", f"concat(p, {rest})")


def _ssn(key: str) -> str:
    """The numbers that are issued (areas 001 to 899 but 666, groups from 01, serials from 0001) are permuted; others stay."""
    parts = "transform(split(v, '[- ]'), x -> cast(x AS bigint))"
    index = "(CASE WHEN o[0] > 666 THEN o[0] - 2 ELSE o[0] - 1 END) * 989901 + (o[1] - 1) * 9999 + o[2] - 1"
    area = "CASE WHEN n div 989901 >= 665 THEN n div 989901 + 2 ELSE n div 989901 + 1 END"
    back = f"concat_ws(substr(v, 4, 1), lpad({area}, 3, '0'), lpad(n % 989901 div 9999 + 1, 2, '0'), lpad(n % 9999 + 1, 4, '0'))"
    issued = "o[0] BETWEEN 1 AND 899 AND o[0] <> 666 AND o[1] > 0 AND o[2] > 0"
    return _let(parts, "o", f"CASE WHEN {issued} THEN {_let(_permute_number(index, key, 'ssn', 898, 989901), 'n', back)} ELSE v END")


def _ipv6(key: str) -> str:
    """Digits and letters are permuted within theirs, so that one notation stays one; :: with eight parts beside it is no address and stays."""
    parts = "size(filter(split(v, ':'), x -> x <> ''))"
    return f"CASE WHEN v LIKE '%::%' AND {parts} > 7 THEN v ELSE {_permute('v', key, 'ipv6', 6)} END"


def _access_key(key: str) -> str:
    """What names the issuer stays; the rest is permuted."""
    return _let(f"regexp_extract(v, '^(?:{ISSUED})', 0)", "p", f"concat(p, {_permute('substr(v, length(p) + 1)', key, 'access_key')})")


def _kind() -> str:
    """SQL: the kind of a found value v, by the first pattern that takes it whole."""
    whole = {k: p if "(?<!" not in p[:5] else p[p.index(")") + 1 :] for k, p in PATTERNS.items()}
    return "CASE " + " ".join(f"WHEN v RLIKE {_quoted('^(?:' + p + ')$')} THEN '{k}'" for k, p in whole.items()) + " END"


def _pseudonym(key: str) -> str:
    """SQL: the pseudonym of a found value v; key is the SQL of the key."""
    by_kind = {"email": _email(key), "secret": _permute("v", key, "secret", 6), "access_key": _access_key(key), "iban": _iban(key), "date": _date(key), "ip": _ip(key), "ipv6": _ipv6(key), "ssn": _ssn(key), "card": _card(key), "phone": _phone(key)}
    return _let(_kind(), "kind", "CASE kind " + " ".join(f"WHEN '{k}' THEN {e}" for k, e in by_kind.items()) + " ELSE v END")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "_pii") -> DataFrame:
    """The rows and columns of docs with the text's values replaced, and found_col: an array of (kind, value) of what was
    replaced, in order; value is the pseudonym.

    A null text stays null, with an empty array; so does an empty one. Values that fail their kind's check (an impossible
    date, an address part over 255, a wrong IBAN or card sum, a number that is not issued) are no personal data and stay. A
    permutation may leave a value of one or two characters as it is; nothing unchanged is listed. Each row is worked off by
    itself: ids may be null or repeat, texts may be of any length, other columns may have any name but found_col (an error).
    An empty table gives an empty result. Not found are
    passwords, names, postal addresses, and IPv6 addresses in two notations as equal ones.
    """
    if found_col in docs.columns:
        raise ValueError(f"docs has a column {found_col} already")
    text, matched, made, secret = F.col(text_col), unused(docs, "_matched"), unused(docs, "_made"), unused(docs, "_secret")
    held = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    pattern = F.lit(ANY)
    none = F.array().cast("array<struct<kind:string,value:string,old:string>>")
    found = F.coalesce(F.when(text.rlike(HINT), F.regexp_extract_all(text, pattern, F.lit(0))), F.array().cast("array<string>"))
    kinds = F.expr(f"transform(`{matched}`, v -> named_struct('kind', {_kind()}, 'value', {_pseudonym(f'`{secret}`')}, 'old', v))")
    rows = docs.withColumn(secret, held).withColumn(matched, found).withColumn(made, F.when(F.size(matched) > 0, kinds).otherwise(none))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(between, F.expr(f"`{made}`.value"), lambda t, v: F.concat(t, F.coalesce(v, F.lit("")))), "")
    changed = F.expr(f"transform(filter(`{made}`, x -> x.value <> x.old), x -> named_struct('kind', x.kind, 'value', x.value))")
    return rows.withColumn(text_col, F.when(F.size(matched) > 0, joined).otherwise(text)).withColumn(found_col, changed).drop(matched, made, secret)


def counts(pii: Column) -> Column:
    """How many values were replaced."""
    return F.size(pii).cast("long")
