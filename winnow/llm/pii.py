"""Format-preserving pseudonyms for personal data, in SQL expressions alone.

Found values are checked (Luhn, mod-97, calendar, octet and numbering-plan rules), and only valid ones change. A keyed Feistel
network permutes the values of each kind within their format: halves take turns, each shifted by a keyed SHA-2 hash of the
other, digit by digit or modulo the halves' sizes. It is a bijection, so equal values become equal pseudonyms in every
document and different values stay different; check digits are computed anew.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.llm.common import free_name

ROUNDS = 10
DIGITS, HEX, ALNUM = "0123456789", "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyz"
#: 400 years of the Gregorian calendar have 146097 = 209 * 699 days, whatever day they begin with.
FIRST_DAY, DATE_SIDES = "1700-01-01", (209, 699)
#: The other days of the years 1 to 9999: 620547 before and the rest after, 3505962 = 762 * 4601 in all.
DAYS_BEFORE, OTHER_SIDES = 620_547, (762, 4601)

#: Up to 64 characters before the sign (RFC 5321). Groups repeat possessively, which Java does in a loop: others recurse, and overflow
#: the stack on long input. A label may be followed by labels that can't be the last; it goes on where two letters follow a point.
LOCAL = r"[A-Za-z0-9._%+-]{1,64}+@"
EMAIL = rf"(?<![A-Za-z0-9._%+-]){LOCAL}(?:[A-Za-z0-9-]++(?:\.(?![A-Za-z]{{2}})[A-Za-z0-9-]++)*+\.(?=[A-Za-z]{{2}}))++[A-Za-z]{{2,}}+"
SECRET = r"(?<=(?:password|passwd|secret|token|key)[ \t]{0,3}[=:][ \t]{0,3}[\"']{0,1})[0-9A-Fa-f]{8,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[/.-][0-9])"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9.])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: What can stand beside a card and begins with digits, but has other characters than a run of digits.
BESIDE = r"[ -](?:(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])|[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9]|[/.-][0-9])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9]|[/.-][0-9])|(?=[0-9 -]{0,8}[.(])(?:1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|" + LOCAL + ")"
#: Digits with single spaces or hyphens: a card with whatever numbers stand around it.
RUN = rf"(?<![0-9.])[0-9](?:(?!{BESIDE})[ -]?[0-9]){{12,}}+"
#: Digits of the numbers that a card is written as; an unbroken one has 13 to 19. The first layout that gives a valid card counts.
LAYOUTS = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)]
BLOCK = 256
FOUND = "|".join([EMAIL, SECRET, IBAN, IP, DATE, SSN, PHONE, RUN])
LEFT = "|".join([DATE, SSN, PHONE, CARD])


def _text(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def chars_feistel(x: str, alphabet: str, kind: str, key: str) -> str:
    """The string x over the alphabet, permuted among the strings of its length; under two characters it stays.

    Works in time in proportion to the length: characters are parted once a round. A hash has digits for 32 characters; each
    further 32 have a hash of their own, keyed and made from the first one, so no two characters share a shift.
    """
    r = len(alphabet)

    def shifted(side: str, other: str) -> str:
        one = f"substr('{alphabet}', cast(pmod(instr('{alphabet}', c) - 1 + cast(conv(substr(get(hs, cast(j div 32 as int)), 4 * (j % 32) + 1, 4), 16, 10) as bigint), {r}) as int) + 1, 1)"
        blocks = f"transform(sequence(0, cast((length({side}) - 1) div 32 as int)), b -> if(b = 0, d, sha2(concat({_text(key + '|' + kind + '|')}, d, '|', b), 512)))"
        return _let("d", f"sha2(concat({_text(key + '|' + kind + '|')}, i, '|', {other}), 512)", _let("hs", blocks, f"array_join(transform(split({side}, ''), (c, j) -> {one}), '')"))

    step = f"if(i % 2 = 1, named_struct('a', {shifted('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {shifted('s.b', 's.a')}))"
    walk = f"aggregate(sequence(1, {ROUNDS}), named_struct('a', left(x, cast(length(x) div 2 as int)), 'b', substr(x, cast(length(x) div 2 as int) + 1)), (s, i) -> {step}, s -> concat(s.a, s.b))"
    return _let("x", x, f"if(length(x) < 2, x, {walk})")


def sides_feistel(a: str, b: str, sides: tuple[int, int], kind: str, key: str) -> str:
    """Struct (a, b) of integers below the two sides, permuted among all such pairs."""
    h = lambda other: f"cast(conv(left(sha2(concat({_text(key + '|' + kind + '|')}, i, '|', cast({other} as string)), 256), 12), 16, 10) as bigint)"
    step = f"if(i % 2 = 1, named_struct('a', (s.a + {h('s.b')}) % {sides[0]}L, 'b', s.b), named_struct('a', s.a, 'b', (s.b + {h('s.a')}) % {sides[1]}L))"
    return f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> {step})"


def refilled(form: str, fill: str, change: str = "[0-9]") -> str:
    """form with its characters of the class `change` replaced, in order, by those of fill."""
    return _let("f", f"split({fill}, '')", f"array_join(transform(split({form}, '{change}', -1), (c, k) -> concat(c, coalesce(get(f, k), ''))), '')")


def luhn_digit(payload: str) -> str:
    twice = "if(j % 2 = 1, if(2 * n > 9, 2 * n - 9, 2 * n), n)"
    one = _let("n", "cast(substr(p, length(p) + 1 - j, 1) as int)", twice)
    return _let("p", payload, f"cast((10 - aggregate(sequence(1, length(p)), 0, (t, j) -> t + {one}) % 10) % 10 as string)")


def mod_97(chars: str) -> str:
    return f"aggregate(split({chars}, ''), 0, (t, c) -> if(c between '0' and '9', t * 10 + cast(c as int), t * 100 + ascii(c) - 55) % 97)"


def _email(key: str) -> str:
    at = "length(m) - length(substring_index(m, '.', -1))"  # what comes before the last label changes
    return _let("e", f"lower(left(m, {at}))", f"concat({refilled('e', chars_feistel('regexp_replace(e, ' + _text('[^a-z0-9]') + ', ' + _text('') + ')', ALNUM, 'email', key), '[a-z0-9]')}, lower(substring_index(m, '.', -1)))")


def _card(key: str) -> str:
    d = "regexp_replace(m, '[^0-9]', '')"
    payload = f"concat(left(d, 1), {chars_feistel('substr(d, 2, length(d) - 2)', DIGITS, 'card', key)})"
    return _let("d", d, _let("y", payload, refilled("m", f"concat(y, {luhn_digit('y')})")))


def _phone(key: str) -> str:
    moved = chars_feistel("concat(substr(t, 2, 2), substr(t, 5, 6))", DIGITS, "phone", key)
    whole = _let("y", moved, "concat(left(d, length(d) - 10), left(t, 1), left(y, 2), substr(t, 4, 1), substr(y, 3))")
    return _let("d", "regexp_replace(m, '[^0-9]', '')", _let("t", "right(d, 10)", refilled("m", whole)))


def _iban(key: str) -> str:
    # the account's digits move; its letters, country and length stay
    moved = refilled("substr(d, 5)", chars_feistel("regexp_replace(substr(d, 5), '[^0-9]', '')", DIGITS, "iban", key))
    check = f"lpad(cast(98 - {mod_97('concat(y, left(d, 2), ' + _text('00') + ')')} as string), 2, '0')"
    whole = _let("y", moved, f"concat(left(d, 2), {check}, y)")
    return _let("d", "regexp_replace(m, ' ', '')", refilled("m", whole, "[^ ]"))


def _ip(key: str) -> str:
    octet = lambda k: f"cast(split(m, '[.]')[{k}] as int)"
    new = sides_feistel(f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", (65536, 65536), "ip", key)
    return _let("y", new, "concat_ws('.', y.a div 256, y.a % 256, y.b div 256, y.b % 256)")


def _ssn(key: str) -> str:
    area = "cast(left(m, 3) as int)"
    a = f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + cast(substr(m, 5, 2) as int) - 1"
    new = sides_feistel(a, "cast(right(m, 4) as int) - 1", (898 * 99, 9999), "ssn", key)
    area_of = "y.a div 99 + 1 + if(y.a div 99 + 1 >= 666, 1, 0)"
    return _let("y", new, f"concat(lpad(cast({area_of} as string), 3, '0'), '-', lpad(cast(y.a % 99 + 1 as string), 2, '0'), '-', lpad(cast(y.b + 1 as string), 4, '0'))")


def _date(form: str, key: str) -> str:
    day = f"datediff(cast(try_to_timestamp(m, '{form}') as date), date'{FIRST_DAY}')"

    def moved(n: str, sides: tuple[int, int], kind: str, back: str) -> str:
        new = sides_feistel(f"({n}) div {sides[1]}", f"({n}) % {sides[1]}", sides, kind, key)
        return _let("y", f"transform(array({new}), v -> cast(v.a * {sides[1]} + v.b as int))[0]", f"date_format(date_add(date'{FIRST_DAY}', {back}), '{form}')")

    days = DATE_SIDES[0] * DATE_SIDES[1]
    others = moved(f"if(n < 0, n, n - {days}) + {DAYS_BEFORE}", OTHER_SIDES, "other-date", f"y - {DAYS_BEFORE} + if(y < {DAYS_BEFORE}, 0, {days})")
    return _let("n", day, f"if(n between 0 and {days - 1}, {moved('n', DATE_SIDES, 'date', 'y')}, {others})")


def pseudonym(key: str) -> str:
    """SQL for the value of the found string m: its pseudonym, or m itself if it isn't valid."""
    real = lambda form: f"try_to_timestamp(m, '{form}') is not null"
    cases = [
        ("contains(m, '@')", _email(key)),
        ("m rlike '^[0-9]{4}-' and m rlike '^[0-9-]{10}$' and " + real("yyyy-MM-dd"), _date("yyyy-MM-dd", key)),
        ("m rlike '^[0-9]{4}/../..$' and " + real("yyyy/MM/dd"), _date("yyyy/MM/dd", key)),
        ("m rlike '^../../....$' and " + real("dd/MM/yyyy"), _date("dd/MM/yyyy", key)),
        ("m rlike '^../../....$' and " + real("MM/dd/yyyy"), _date("MM/dd/yyyy", key)),
        ("m rlike '^..[.]..[.]....$' and " + real("dd.MM.yyyy"), _date("dd.MM.yyyy", key)),
        ("m rlike '^([0-9]+[.]){3}[0-9]+$' and not exists(split(m, '[.]'), o -> cast(o as int) > 255)", _ip(key)),
        ("m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' and left(m, 3) not in ('000', '666') and left(m, 1) <> '9' and substr(m, 5, 2) <> '00' and right(m, 4) <> '0000'", _ssn(key)),
        ("m rlike '^[+]?1?[ .-]?([(][2-9][0-9]{2}[)] ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}$'", _phone(key)),
        ("m rlike '^[0-9 -]{13,}$' and luhn_check(regexp_replace(m, '[^0-9]', ''))", _card(key)),
        (f"m rlike '^[A-Z]{{2}}[0-9]{{2}}' and {_let('z', 'regexp_replace(m, ' + _text(' ') + ', ' + _text('') + ')', mod_97('concat(substr(z, 5), left(z, 4))') + ' = 1')}", _iban(key)),
        ("m rlike '^[0-9A-Fa-f]{8,}$' and m rlike '[A-Fa-f]'", chars_feistel("lower(m)", HEX, "secret", key)),
    ]
    return "case " + " ".join(f"when {when} then {then}" for when, then in cases) + " else m end"


def _cards(nums: str) -> str:
    """SQL for the array of (at, n) of the valid cards among the numbers, from left to right: n numbers from the place at on."""
    part = lambda k: f"coalesce(get({nums}, j + {k}), '')" if k else "x"
    cases = "when length(x) between 13 and 19 and luhn_check(x) then 1 "
    for layout in LAYOUTS:
        fits = " and ".join(f"length({part(k)}) = {n}" for k, n in enumerate(layout))
        cases += f"when {fits} and luhn_check(concat({', '.join(part(k) for k in range(len(layout)))})) then {len(layout)} "
    valid = f"filter(transform({nums}, (x, j) -> named_struct('at', j, 'n', case {cases}else 0 end)), v -> v.n > 0)"
    # taken block by block: a growing array is copied at each step
    nothing = "cast(array() as array<struct<at:int,n:int>>)"
    inner = f"aggregate(block, named_struct('out', {nothing}, 'next', o.next), (s, v) -> if(v.at < s.next, s, named_struct('out', concat(s.out, array(v)), 'next', v.at + v.n)))"
    outer = _let("q", inner, "named_struct('out', concat(o.out, array(q.out)), 'next', q.next)")
    blocks = f"transform(sequence(0, cast(size(vs) div {BLOCK} as int)), b -> slice(vs, b * {BLOCK} + 1, {BLOCK}))"
    return _let("vs", valid, f"aggregate({blocks}, named_struct('out', array({nothing}), 'next', 0), (o, block) -> {outer}, o -> flatten(o.out))")


def _pieces(m: str) -> str:
    """SQL for the found string m in pieces, structs (old, value): of a run of digits its cards and what stands between them.

    The first valid card of a layout is taken, then the next after it. What is left is searched for the other kinds of
    numbers and for cards parted in another way.
    """
    # r.nums[j] is followed by r.gaps[j]; what stands between cards k - 1 and k begins with the gap after card k - 1
    # numbers are looked up one by one: slice() copies the whole array each time
    upto = lambda u, v: f"array_join(transform(if({v} > {u}, sequence({u}, {v} - 1), cast(array() as array<int>)), j -> concat(get(r.nums, j), coalesce(get(r.gaps, j), ''))), '')"
    end = "coalesce(get(cs, k - 1).at + get(cs, k - 1).n, 0)"
    between = f"concat(if(k > 0, coalesce(get(r.gaps, {end} - 1), ''), ''), {upto(end, 'coalesce(get(cs, k).at, size(r.nums))')})"
    card = f"concat({upto('get(cs, k).at', 'get(cs, k).at + get(cs, k).n - 1')}, get(r.nums, get(cs, k).at + get(cs, k).n - 1))"
    left = _text(LEFT)
    rest = f"flatten(transform(split(o, {left}, -1), (x, q) -> array(named_struct('old', x, 'value', false), named_struct('old', coalesce(get(vs, q), ''), 'value', true))))"
    rest = _let("o", between, _let("vs", f"regexp_extract_all(o, {left}, 0)", rest))
    both = f"concat({rest}, if(k < size(cs), array(named_struct('old', {card}, 'value', true)), cast(array() as array<struct<old:string,value:boolean>>)))"
    run = _let("r", "named_struct('nums', split(m, '[ -]'), 'gaps', regexp_extract_all(m, '[ -]', 0))", _let("cs", _cards("r.nums"), f"flatten(transform(sequence(0, size(cs)), k -> {both}))"))
    return _let("m", m, f"if(m rlike '^[0-9]([ -]?[0-9]){{12,}}+$', {run}, array(named_struct('old', m, 'value', true)))")


def pseudonymised(text: str, key: str) -> Column:
    """Struct (text, n): the column's text with its values replaced, and how many were found valid and changed."""
    found = _text(FOUND)
    new = _let("m", "x.old", pseudonym(key))
    values = f"transform(regexp_extract_all({text}, {found}, 0), f -> transform({_pieces('f')}, x -> named_struct('old', x.old, 'new', if(x.value, {new}, x.old))))"
    joined = "array_join(transform(r.parts, (p, k) -> concat(p, coalesce(array_join(get(r.vals, k).new, ''), ''))), '')"
    pair = f"named_struct('parts', split({text}, {found}, -1), 'vals', {values})"
    whole = _let("r", pair, f"named_struct('text', {joined}, 'n', size(filter(flatten(r.vals), v -> v.old <> v.new)))")
    none = f"named_struct('text', {text}, 'n', 0)"
    return F.expr(f"if({text} rlike '[0-9@=:]', {whole}, {none})")


#: The setting that names the key. It is a secret; spark.redaction.string.regex keeps it out of printed plans.
KEY_SETTING = "spark.winnow.pii.key"
_drawn: dict[str, str] = {}


def key_of(spark: SparkSession) -> str:
    """The key in KEY_SETTING; where it is unset a random one, drawn once for each application: values are then linked within it alone."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def with_pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced and n_replaced added (an input column of that name, in whatever case, is replaced).

    Works on whole texts of any length. A null or empty text stays as it is; values that aren't valid stay; every row is kept,
    repeated rows too, and so are all other columns, whatever their names. No rows: no rows.
    """
    names, pii = [c for c in docs.columns if c.lower() != "n_replaced"], free_name(docs, "pii")
    done = docs.select(*[F.col(f"`{c}`") for c in names], pseudonymised("text", key).alias(pii))
    return done.select(*[F.col(f"{pii}.text").alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in names], F.coalesce(f"{pii}.n", F.lit(0)).alias("n_replaced"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced of every document, under the session's key.

    Null and empty texts stay as they are, repeated rows are kept; see with_pseudonyms().
    """
    return with_pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key_of(spark))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: all documents, their texts with pseudonyms and n_chars counted anew (null for a null text).

    Every row stays, nulls, empty texts and repeated rows too; columns beyond those of documents stay as they are.
    """
    pii = free_name(docs, "pii")
    done = docs.select(*[F.col(f"`{c}`") for c in docs.columns], pseudonymised("text", key_of(spark)).alias(pii))
    new = {"text": F.col(f"{pii}.text"), "n_chars": F.length(f"{pii}.text").cast("long")}
    return done.select(*[new[c.lower()].alias(c) if c.lower() in new else F.col(f"`{c}`") for c in docs.columns])
