"""Block identifiers: a lossy 26-letter code with checksum, similarity, and look-alike repair."""

from __future__ import annotations

from functools import cache, reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstack.functions.once import once

# The alphabet, look-alikes of each character, and look-alikes of hexadecimal digits.
ALPHABET = "34679ACDEFGHJKLMNPQRTUVWXY"
LOOKALIKES = {
    "0": "ODQC", "1": "LTJ", "2": "Z7", "5": "S6", "8": "B369", "Z": "27", "B": "836ER", "S": "56", "O": "0DQ", "I": "1LT",
    "3": "89E", "4": "AH", "6": "G85", "7": "T2Y", "9": "P86", "A": "4HR", "D": "0OQ", "E": "F3B", "F": "EP", "G": "6CQ", "H": "A4MN", "K": "XR",
    "M": "NHW", "N": "MH", "P": "RF9", "Q": "0OD", "R": "PKA", "T": "7Y1", "U": "VW", "V": "UY", "W": "MV", "X": "KY", "Y": "VT7",
}
DIGITS = "0123456789ABCDEFGHIJKLMNOP"
HEX_FROM, HEX_TO = "OoIl|!іІSsGg", "001111115566"
PAYLOAD, CHECK = 8, 3
SPAN = 26 ** PAYLOAD
#: What a payload's letter at its place is worth in the checksum's three sums, in fields of 16 bits.
_SUMS = [1 | i + 3 << 16 | (i + 7) * (i + 1) << 32 for i in range(PAYLOAD)]


def _letter(n: Column) -> Column:
    return F.substring(F.lit(ALPHABET), (n % 26 + 1).cast("int"), F.lit(1))


def value_at(code: Column, i: int) -> Column:
    """The place of a code's letter in the alphabet; 0 for a letter that isn't there."""
    return F.greatest(F.instr(F.lit(ALPHABET), F.substring(code, i + 1, 1)) - 1, F.lit(0))


def checksum(payload: Column) -> Column:
    """Three letters: sums of the letters' values, plain and with two weights by place."""
    values = F.array(*(F.when(F.length(payload) > i, value_at(payload, i)).otherwise(0) for i in range(PAYLOAD)))
    def letters(v: Column) -> Column:
        weighed = lambda weight: _letter(sum((v[i] * weight(i) for i in range(1, PAYLOAD)), v[0] * weight(0)))
        return F.concat(weighed(lambda i: 1), weighed(lambda i: i + 3), weighed(lambda i: (i + 7) * (i + 1)))
    return once(values, letters)


def _number(uuid: Column) -> Column:
    """The first ten hexadecimal digits of a uuid."""
    return F.conv(F.substring(F.lower(F.replace(uuid, F.lit("-"), F.lit(""))), 1, 10), 16, 10).cast("long")


def _short(n: Column) -> Column:
    """A 40-bit number that eight letters hold; one that needs nine loses its last, as ids have always been written."""
    return F.when(n >= SPAN, F.floor(n / 26)).otherwise(n)


def _sums_of(short: Column) -> Column:
    """The checksum's three sums of a number's eight letters, in fields of 16 bits; they come from its digits, no letter is looked up."""
    digits = [F.call_function("div", short, F.lit(26 ** (PAYLOAD - 1 - i))) % 26 for i in range(PAYLOAD)]
    return reduce(Column.__add__, (d * F.lit(w) for d, w in zip(digits, _SUMS, strict=True)))


def _code(short: Column, sums: Column) -> Column:
    """XXXX-XXXX-XXX: eight letters for a number, then those of its sums."""
    payload = F.translate(F.lpad(F.conv(short.cast("string"), 10, 26), PAYLOAD, "0"), DIGITS, ALPHABET)
    check = F.concat(_letter(sums % 65536), _letter(F.shiftright(sums, 16) % 65536), _letter(F.shiftright(sums, 32)))
    return F.overlay(F.overlay(F.concat(payload, check), F.lit("-"), 9, 0), F.lit("-"), 5, 0)


def dashed(code: Column) -> Column:
    return F.concat_ws("-", F.substring(code, 1, 4), F.substring(code, 5, 4), F.substring(code, 9, 3))


def plain(code: Column) -> Column:
    return F.upper(F.regexp_replace(code, "[- ]", ""))


def encode(uuid: Column) -> Column:
    """XXXX-XXXX-XXX from the first ten hexadecimal digits of a uuid."""
    return once(once(_number(uuid), _short), lambda n: once(_sums_of(n), lambda s: _code(n, s)))


def with_codes(df: DataFrame, uuids: dict[str, Column]) -> DataFrame:
    """df with the codes of uuids as columns of these names: encode() in projections of its own, for many rows."""
    named = lambda k, f: {f"_{k}_{c}": f(c) for c in uuids}
    at = lambda k, c: F.col(f"_{k}_{c}")
    steps = df.withColumns(named("number", lambda c: _number(uuids[c]))).withColumns(named("short", lambda c: _short(at("number", c)))).withColumns(named("sums", lambda c: _sums_of(at("short", c))))
    return steps.withColumns({c: _code(at("short", c), at("sums", c)) for c in uuids}).drop(*(f"_{k}_{c}" for k in ("number", "short", "sums") for c in uuids))


def _valid(clean: Column) -> Column:
    return F.coalesce(clean.rlike(f"^[{ALPHABET}]{{11}}$") & (F.substring(clean, 9, 3) == checksum(F.substring(clean, 1, 8))), F.lit(False))


def is_valid(code: Column) -> Column:
    """Whether 11 letters of the alphabet end in the checksum of the first eight."""
    return once(plain(code), _valid)


def is_code(block_id: Column) -> Column:
    """Whether an id has the form of a code, whatever its checksum."""
    return F.coalesce(F.upper(F.replace(block_id, F.lit("-"), F.lit(""))).rlike(f"^[{ALPHABET}]{{11}}$"), F.lit(False))


def decode(code: Column) -> Column:
    """Ten hexadecimal digits of a valid code, else null."""
    digits = lambda c: F.lpad(F.lower(F.conv(F.translate(F.substring(c, 1, PAYLOAD), ALPHABET, DIGITS), 26, 16)), 10, "0")
    return once(plain(code), lambda c: F.when(_valid(c), digits(c)))


def migrated(block_id: Column) -> Column:
    """The id as a code: as it is if it is one, else encoded."""
    return F.when(is_code(block_id), block_id).otherwise(encode(block_id))


def similarity(a: Column, b: Column) -> Column:
    """Percent of the longer string that needs no edit; 0 if either is empty or null."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(F.coalesce(F.length(a), F.lit(0)) * F.coalesce(F.length(b), F.lit(0)) == 0, F.lit(0.0)).when(a == b, F.lit(100.0)).otherwise(
        (longest - F.levenshtein(a, b)) / longest * 100)


def normal_uuid(text: Column) -> Column:
    """A recognised uuid with look-alike letters mapped to digits and all else but hexadecimals dropped; null if too short."""
    digits = F.regexp_replace(F.lower(F.translate(F.trim(text), HEX_FROM, HEX_TO)), "[^0-9a-f]", "")
    cut = F.substring(digits, 1, 32)
    parts = [F.substring(cut, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(F.length(cut) == 32, F.concat_ws("-", *parts))


#: What a letter at its place adds to the checksum's three sums, in fields of ten bits; letters of the checksum take from one.
_WEIGHTS = [(1, i + 3, (i + 7) * (i + 1)) for i in range(PAYLOAD)] + [(-1, 0, 0), (0, -1, 0), (0, 0, -1)]
_ADDS = [{x: sum(w * v % 26 << 10 * k for k, w in enumerate(weights)) for v, x in enumerate(ALPHABET)} for weights in _WEIGHTS]


def _rests(sums: int) -> tuple[int, int, int]:
    """What the three sums leave by 26."""
    return (sums & 1023) % 26, (sums >> 10 & 1023) % 26, (sums >> 20) % 26


#: By place, the letter that makes up for what the sums leave.
_FITS = [{tuple(-r % 26 for r in _rests(n)): x for x, n in adds.items()} for adds in _ADDS]


def _checks(code: str) -> bool:
    try:
        return len(code) == PAYLOAD + CHECK and _rests(sum([adds[x] for adds, x in zip(_ADDS, code, strict=True)])) == (0, 0, 0)
    except KeyError:
        return False


def _put_in(code: str) -> str | None:
    """The first valid code with one letter more: the sums name the letter for each place."""
    if not all(x in _ADDS[0] for x in code):
        return None
    sums = sum(adds[x] for adds, x in zip(_ADDS[1:], code, strict=True))
    for i, fits in enumerate(_FITS):
        x = fits.get(_rests(sums))
        if x:
            return code[:i] + x + code[i:]
        if i < len(code):
            sums += _ADDS[i][code[i]] - _ADDS[i + 1][code[i]]
    return None


def repaired(code: str | None, most: int = 3) -> str | None:
    """The valid code closest to a damaged one: itself, one letter put in or taken out, or up to three characters changed.

    A character becomes one of its look-alikes; one without any that isn't in the alphabet, one of the alphabet's first
    eight. The first found in alphabetical order of changes, with dashes; null if there is none.
    """
    c = (code or "").replace("-", "").replace(" ", "").upper()
    with_dashes = lambda t: f"{t[:4]}-{t[4:8]}-{t[8:]}"
    if _checks(c):
        return with_dashes(c)
    if len(c) == PAYLOAD + CHECK - 1:
        tries = filter(None, [_put_in(c)])
    elif len(c) == PAYLOAD + CHECK + 1:
        tries = (c[:i] + c[i + 1:] for i in range(len(c)))
    elif len(c) == PAYLOAD + CHECK:
        tries = filter(None, (_changed(c, n) for n in range(1, most + 1)))
    else:
        return None
    return next((with_dashes(t) for t in tries if _checks(t)), None)


@cache
def _changes(i: int, x: str) -> list[tuple[int, str]]:
    """(what it adds to the sums, letter) of each letter that may stand for one at a place."""
    letters = sorted(y for y in LOOKALIKES.get(x, "") if y in ALPHABET) or ([] if x in ALPHABET else list(ALPHABET[:8]))
    less = _rests(_ADDS[i].get(x, 0))
    return [(sum((r - o) % 26 << 10 * k for k, (r, o) in enumerate(zip(_rests(_ADDS[i][y]), less, strict=True))), y) for y in letters]


def _changed(code: str, n: int) -> str | None:
    """The first valid code with n characters changed: for any changes but the last, the sums name what the last may be."""
    unread = {i for i, x in enumerate(code) if x not in ALPHABET}
    if len(unread) > n:
        return None
    either = [_changes(i, x) for i, x in enumerate(code)]
    sums = _rests(sum(adds.get(x, 0) for adds, x in zip(_ADDS, code, strict=True)))
    last: dict[int, list[tuple[int, str]]] = {}  # by the sums that changes before it must add, as they come: of n - 1 rests
    for i, letters in enumerate(either):
        for added, y in letters:
            need = [range((-s - r) % 26, 26 * max(n - 1, 1), 26) for s, r in zip(sums, _rests(added), strict=True)]
            for a, b, c in product(*need):
                last.setdefault(a | b << 10 | c << 20, []).append((i, y))
    for places in combinations([i for i, x in enumerate(either) if x], n - 1):
        made_up = [0]
        for p in places:
            made_up = [m + added for m in made_up for added, _ in either[p]]
        if last.keys().isdisjoint(made_up):
            continue
        end, open_ = places[-1] if places else -1, unread.difference(places)
        found = [(i, (*letters, y)) for m, letters in zip(made_up, product(*([y for _, y in either[p]] for p in places)), strict=True)
                 for i, y in last.get(m, ()) if i > end and open_ <= {i}]
        if found:
            i, letters = min(found)
            made = list(code)
            for at, y in zip((*places, i), letters, strict=True):
                made[at] = y
            return "".join(made)
    return None


@F.pandas_udf(T.StringType())
def repair(codes):
    """repaired() over a column."""
    return codes.map(repaired)
