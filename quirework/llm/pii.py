"""Pseudonyms for personal data by DataFrame functions alone.

Numbers and dates that pass their format's check are permuted within the format by a keyed
Feistel network: a payment card becomes another number of its length and first digit that
passes the Luhn check, an IPv4 address another address, a phone number another number of the
same plan with the same country code and punctuation, a social security number another issuable
one, a date another date of the years 1800-2099 in the same order of day and month (a date that can
be read as day, month, year is read so, and stays such a one).  Each map is one-to-one and depends on the key
and the value only, so equal values stay linked across documents and different ones apart.
E-mail addresses and credentials, which have no fixed set of valid values, get keyed
one-way names instead (also the same for equal values).

A text is cut at all matches of one alternation; the matches are mapped and put back between
the pieces.  Texts without a sign of any of them (MAYBE) are passed on as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import unused

ROUNDS = 10
FIRST_DAY, DAYS = "1800-01-01", 109_573

# The patterns of what is looked for, in the order in which they are tried.
PATTERNS = {
    "email": r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "secret": r"(?:(?<=(?i:token|secret|password|passwd|api_key|apikey|api-key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)(?=[A-Za-z+/_=-]*+\d)[A-Za-z0-9+/_-][A-Za-z0-9+/_=-]{11,}+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "date": r"(?<![\w./-])(?:(?:18|19|20)\d{2}-\d{2}-\d{2}|\d{2}([./-])\d{2}\1(?:18|19|20)\d{2})(?![\w/-]|\.\d)",
    "card": r"(?<![\w.+-])(?:[1-9]\d{12,18}|[1-9]\d{3}(?:[ -]\d{4}){3}|3\d{3}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "phone": r"(?<![\w+.])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([.-])\d{3}\2\d{4})(?![\w-]|\.\d)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
MAYBE = r"[0-9][0-9]|@|[0-9][.][0-9]|AKIA|(?i:token|secret|passw|api.?key)"


def quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(value: str, a: str, b: str, tweak: str, key: str) -> str:
    """SQL of a keyed permutation of 0 .. a*b-1: the parts modulo a and b in turn get a keyed hash of the other added."""
    mark = lambda part, mod: f"cast(conv(substr(sha2(concat_ws(':', {quoted(key)}, {tweak}, cast(r as string), cast({part} as string)), 256), 1, 15), 16, 10) as bigint) % ({mod})"
    step = f"case when r % 2 = 0 then named_struct('x', (s.x + {mark('s.y', a)}) % ({a}), 'y', s.y) else named_struct('x', s.x, 'y', (s.y + {mark('s.x', b)}) % ({b})) end"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('x', cast(({value}) div ({b}) as bigint), 'y', cast(({value}) % ({b}) as bigint)), (s, r) -> {step}, s -> s.x * ({b}) + s.y)"


def decimal(digits: str, tweak: str, key: str) -> str:
    """SQL of a permutation of the digit strings of one length (2 to 18)."""
    n = f"length({digits})"
    power = lambda k: f"cast(rpad('1', cast({k} as int) + 1, '0') as bigint)"
    return f"lpad(cast({feistel(f'cast({digits} as bigint)', power(f'{n} div 2'), power(f'{n} - {n} div 2'), f'concat({tweak}, {n})', key)} as string), {n}, '0')"


def luhn_sum(digits: str, odd: int) -> str:
    """Sum of the digits from the right, each second one doubled; the rightmost one is doubled if odd is 0."""
    return f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + case when (length({digits}) - i) % 2 = {odd} then cast(substr({digits}, i, 1) as int) * 2 - case when substr({digits}, i, 1) > '4' then 9 else 0 end else cast(substr({digits}, i, 1) as int) end)"


def refilled(shape: str, digits: str) -> str:
    """SQL of ``shape`` with its digits replaced, in order."""
    return f"array_join(transform(sequence(1, length({shape})), i -> case when substr({shape}, i, 1) between '0' and '9' then substr({digits}, length(regexp_replace(substr({shape}, 1, i), '[^0-9]', '')), 1) else substr({shape}, i, 1) end), '')"


def bound(value: str, name: str, body: str) -> str:
    """SQL of ``body`` with ``name`` for ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def day_map(day: str, key: str) -> str:
    """A permutation of 0 .. DAYS-1: of its first, then of its last 331 * 331 numbers."""
    square = 331 * 331
    first = f"case when {day} < {square} then {feistel(day, '331', '331', quoted('day'), key)} else {day} end"
    rest = DAYS - square
    return bound(first, "u", f"case when u >= {rest} then {rest} + {feistel(f'(u - {rest})', '331', '331', quoted('day2'), key)} else u end")


def month_first(key: str) -> str:
    """SQL of a permutation of the dates m written month, day, year whose day is above 12, so that they can't be read as day, month, year.

    The days to the 28th, the 29th and 30th of months that have them, the 31st and the 29th of
    February are permuted among themselves.
    """
    field = lambda at, n: f"cast(substr(m, {at}, {n}) as bigint)"
    month, dom, year = field(1, 2), field(4, 2), f"({field(7, 4)} - 1800)"
    shown = lambda mon, d, y: f"concat(lpad(cast({mon} as string), 2, '0'), substr(m, 3, 1), lpad(cast({d} as string), 2, '0'), substr(m, 6, 1), cast({y} + 1800 as string))"
    long, leap = "array(1, 3, 5, 7, 8, 10, 12)", f"(({year} - 4) div 4 - case when {year} > 100 then 1 else 0 end)"
    to_28 = bound(feistel(f"(({year} * 12 + {month} - 1) * 16 + {dom} - 13)", "240", "240", quoted("to28"), key), "v", shown("v div 16 % 12 + 1", "v % 16 + 13", "v div 192"))
    to_30 = bound(feistel(f"(({year} * 11 + {month} - case when {month} > 2 then 2 else 1 end) * 2 + {dom} - 29)", "66", "100", quoted("to30"), key), "v", shown("(v div 2 % 11 + case when v div 2 % 11 > 0 then 2 else 1 end)", "v % 2 + 29", "v div 22"))
    last = bound(feistel(f"({year} * 7 + array_position({long}, cast({month} as int)) - 1)", "42", "50", quoted("31"), key), "v", shown(f"element_at({long}, cast(v % 7 + 1 as int))", "31", "v div 7"))
    february = bound(feistel(leap, "73", "1", quoted("29"), key), "v", bound("v + case when v >= 24 then 1 else 0 end", "u", shown("2", "29", "(u * 4 + 4)")))
    return f"case when {dom} <= 28 then {to_28} when {dom} = 31 then {last} when {month} = 2 then {february} else {to_30} end"


def pseudonym(key: str) -> str:
    """SQL of named_struct(kind, new) for the match m; kind is null and new is m where the format's check fails."""
    d = "d"
    struct = lambda kind, new: f"named_struct('kind', {kind}, 'new', {new})"
    same = struct("cast(null as string)", "m")
    name = lambda what, n: f"substr(sha2(concat_ws(':', {quoted(key)}, 'name', lower({what})), 256), 1, {n})"
    email = struct("'email'", f"concat('p', {name('m', 15)}, '@d', {name(r'''substring_index(m, '@', -1)''', 7)}, '.example')")
    hashed = f"sha2(concat_ws(':', {quoted(key)}, 'secret', m), 256)"
    secret = struct("'secret'", f"case when m like 'AKIA%' then concat('AKIA', upper(substr({hashed}, 1, 16))) else substr(repeat({hashed}, cast(ceil(length(m) / 64) as int)), 1, length(m)) end")
    middle = bound(decimal("substr(d, 2, length(d) - 2)", "concat('card', substr(d, 1, 1))", key), "c", bound("concat(substr(d, 1, 1), c)", "e", f"concat(e, cast((10 - {luhn_sum('e', 0)} % 10) % 10 as string))"))
    card = f"case when {luhn_sum(d, 1)} % 10 = 0 then {struct(quoted('card'), refilled('m', middle))} else {same} end"
    area = "(cast(substr(d, 1, 3) as bigint) - case when substr(d, 1, 3) > '666' then 2 else 1 end)"
    number = f"(({area} * 99 + cast(substr(d, 4, 2) as bigint) - 1) * 9999 + cast(substr(d, 6, 4) as bigint) - 1)"
    back = "concat(lpad(cast(v div 989901 + case when v div 989901 >= 665 then 2 else 1 end as string), 3, '0'), '-', lpad(cast(v div 9999 % 99 + 1 as string), 2, '0'), '-', lpad(cast(v % 9999 + 1 as string), 4, '0'))"
    issued = "substr(d, 1, 3) not in ('000', '666') and substr(d, 1, 3) < '900' and substr(d, 4, 2) <> '00' and substr(d, 6, 4) <> '0000'"
    ssn = f"case when {issued} then {struct(quoted('ssn'), bound(feistel(number, '88902', '9999', quoted('ssn'), key), 'v', back))} else {same} end"
    iso = "m rlike '^[0-9]{4}'"
    day = f"case when {iso} then try_cast(m as date) else try_cast(concat_ws('-', substr(m, 7, 4), substr(m, 4, 2), substr(m, 1, 2)) as date) end"
    shown = f"case when {iso} then date_format(w, 'yyyy-MM-dd') else concat(date_format(w, 'dd'), substr(m, 3, 1), date_format(w, 'MM'), substr(m, 6, 1), date_format(w, 'yyyy')) end"
    moved = bound(f"date_add(date'{FIRST_DAY}', cast({day_map(f'''cast(datediff(q, date'{FIRST_DAY}') as bigint)''', key)} as int))", "w", struct("'date'", shown))
    american = "not m rlike '^[0-9]{4}' and try_cast(concat_ws('-', substr(m, 7, 4), substr(m, 1, 2), substr(m, 4, 2)) as date) is not null"
    date = bound(day, "q", f"case when q is not null then {moved} when {american} then {struct(quoted('date'), month_first(key))} else {same} end")
    ten = "length(d) >= 10 and (m not like '+%' or m like '+1%')"
    line = "((cast(substr(t, 1, 3) as bigint) - 200) * 800 + cast(substr(t, 4, 3) as bigint) - 200) * 10000 + cast(substr(t, 7, 4) as bigint)"
    shape = "concat(lpad(cast(v div 8000000 + 200 as string), 3, '0'), lpad(cast(v div 10000 % 800 + 200 as string), 3, '0'), lpad(cast(v % 10000 as string), 4, '0'))"
    nanp = bound("substr(d, -10, 10)", "t", bound(feistel(line, "80000", "80000", quoted("phone"), key), "v", f"concat(substr(d, 1, length(d) - 10), {shape})"))
    # Ten digits that are no number of the plan stay outside of it: those that begin with 0 or 1, and those whose exchange does.
    service = bound(feistel("cast(substr(d, -10, 10) as bigint)", "40000", "50000", quoted("service"), key), "v", "concat(substr(d, 1, length(d) - 10), lpad(cast(v as string), 10, '0'))")
    local = "((cast(substr(t, 1, 3) as bigint) - 200) * 2 + cast(substr(t, 4, 1) as bigint)) * 1000000 + cast(substr(t, 5, 6) as bigint)"
    shown_local = "concat(substr(d, 1, length(d) - 10), cast(v div 2000000 + 200 as string), cast(v div 1000000 % 2 as string), lpad(cast(v % 1000000 as string), 6, '0'))"
    exchange = bound("substr(d, -10, 10)", "t", bound(feistel(local, "40000", "40000", quoted("exchange"), key), "v", shown_local))
    american_phone = f"case when substr(d, -10, 1) < '2' then {service} when substr(d, -7, 1) < '2' then {exchange} else {nanp} end"
    other = bound("least(10, length(d) - 2)", "k", f"concat(substr(d, 1, length(d) - k), {decimal('substr(d, -k, k)', quoted('phone'), key)})")
    phone = f"case when length(d) between 8 and 15 then {struct(quoted('phone'), refilled('m', f'case when {ten} then {american_phone} else {other} end'))} else {same} end"
    octets = bound("transform(split(m, '[.]'), o -> cast(o as bigint))", "o", feistel("(((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3])", "65536", "65536", quoted("ip"), key))
    ip = struct("'ip'", bound(octets, "v", "concat_ws('.', cast(v div 16777216 as string), cast(v div 65536 % 256 as string), cast(v div 256 % 256 as string), cast(v % 256 as string))"))
    which = [
        ("m like '%@%'", email),
        ("m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$'", ssn),
        (r"m rlike '^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[-./][0-9]{2}[-./][0-9]{4})$'", date),
        (r"m rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$'", ip),
        (r"m rlike '^[0-9][0-9 -]{11,36}[0-9]$' and length(d) between 13 and 19", card),
        (r"m rlike '^[+(0-9][-0-9 .()]{7,30}$' and length(d) < 16", phone),
    ]
    cases = " ".join(f"when {c} then {x}" for c, x in which)
    return bound("regexp_replace(m, '[^0-9]', '')", "d", f"case {cases} else {secret} end")


def pseudonymised(text: Column) -> Column:
    """struct<gaps, matches> of a text that may hold personal data, else null."""
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(text.rlike(MAYBE), F.struct(F.split(text, ANY).alias("gaps"), matches.alias("matches")))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All rows and columns of ``docs`` with personal data in ``text`` replaced, and a column n_<kind> for each kind.

    Whoever has ``key`` can invert the pseudonyms, so it is the caller's to choose and keep.  Rows
    stay as they are (order, copies, other columns of any name; columns named n_<kind> are replaced).
    A null text stays null and an empty one empty, with counts of 0; long texts count whole.  An
    empty table gives no rows.
    """
    cut_, new_ = unused(docs, "cut"), unused(docs, "new")
    cut = docs.withColumn(cut_, pseudonymised(F.col("text")))
    mapped = cut.withColumn(new_, F.expr(f"case when size({cut_}.matches) > 0 then transform({cut_}.matches, m -> {pseudonym(key)}) end"))
    text = F.when(F.col(new_).isNull(), F.col("text")).otherwise(F.expr(f"array_join(zip_with({cut_}.gaps, {new_}, (g, n) -> concat(g, coalesce(n.new, ''))), '')"))
    counts = {f"n_{k}": F.coalesce(F.expr(f"size(filter({new_}, n -> n.kind = '{k}'))"), F.lit(0)) for k in PATTERNS}
    return mapped.withColumns({"text": text} | {n: F.when(F.col(new_).isNull(), 0).otherwise(c) for n, c in counts.items()}).drop(cut_, new_)


def pii_documents(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with pseudonyms), n_<kind> and changed of every document; see ``pseudonymise``."""
    out = pseudonymise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), key)
    return out.withColumn("changed", sum(F.col(f"n_{k}") for k in PATTERNS) > 0)
