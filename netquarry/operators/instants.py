"""One instant from start texts in mixed notations, units and zones (problem 6).

Every text is read in every notation it fits, and each reading is a component of
a mixture: a notation with its unit or order of day and month, and whether the
zone stands in the text or is the source's. What is certain is a likelihood of 0
(an instant further than WINDOW_US from arrival, an order of day and month other
than the declared one, fourteen digits as a number); otherwise the likelihood
falls with the delay before arrival. Per source, expectation-maximisation fits
the weights of the components, the posterior chooses the reading, and what stays
unresolved is marked. Where one component fits several instants (a local time
that occurs twice, a year left out) its weight is the same for all of them, so
the likelihood alone decides: the latest one not after arrival.

Parsing works on columns of a batch; a source enters the fit as counts of its
records by signature, that is by their components and rounded delays.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from decimal import Decimal
from zoneinfo import ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquarry.session import cut, small

#: English names of months and weekdays.
SHORT_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
FULL_MONTHS = "january february march april may june july august september october november december".split()
MONTHS = {m: i + 1 for names in (SHORT_MONTHS, FULL_MONTHS) for i, m in enumerate(names)} | {"sept": 9}
DAYS = "mon tue wed thu fri sat sun monday tuesday wednesday thursday friday saturday sunday".split()

DAY_US = 86_400_000_000
WINDOW_US = 400 * DAY_US
#: Likelihood of a reading after arrival against one of the same moment.
AFTER = 1e-6
#: A reading is unresolved where the other components keep more than this share of the posterior.
DOUBT = 0.05

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?)|\s*(?P<abbr>[A-Za-z]{1,5}))?"
_HALF = r"(?:\s*(?P<ap>[AaPp][Mm]))?"
#: Notations of dates; the slashed one is read in both orders of day and month.
PATTERNS = {
    "iso": r"(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})(?:[Tt]|\s+)" + _CLOCK + _ZONE,
    "mail": r"(?:(?P<wd>[A-Za-z]{3,9}),\s*)?(?P<d>\d{1,2})\s+(?P<mon>[A-Za-z]{3,9})\s+(?P<y>\d{4})\s+" + _CLOCK + _HALF + _ZONE,
    "slashed": r"(?P<d>\d{1,2})/(?P<m>\d{1,2})/(?P<y>\d{4})\s+" + _CLOCK + _HALF + _ZONE,
    "yearless": r"(?P<mon>[A-Za-z]{3,9})\s+(?P<d>\d{1,2})\s+" + _CLOCK + _ZONE,
    "dots": r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})\s+" + _CLOCK + _HALF + _ZONE,
    "log": r"(?P<d>\d{1,2})/(?P<mon>[A-Za-z]{3,9})/(?P<y>\d{4}):" + _CLOCK + _ZONE,
    "basic": r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})[Tt](?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?" + _ZONE,
    "packed": r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})",
}
_NUMBER = r"^[+-]?\d+(?:\.\d*)?(?:[eE][+-]?\d{1,3})?$"
_PLAIN = r"^(?P<i>\d{1,18})(?:\.(?P<f>\d*))?$"
#: Microseconds in a unit, as 10 to this power.
UNITS = {"epoch_s": 6, "epoch_ms": 3, "epoch_us": 0, "epoch_ns": -3}
#: Components by number: a notation, and whether its zone stands in the text.
COMPONENTS = [(n, zone) for n in (*UNITS, *(p for p in PATTERNS if p != "slashed"), "dmy", "mdy") for zone in ("site", "text")]
_NUMBER_OF = {c: i for i, c in enumerate(COMPONENTS)}
#: Most components a text has: four units and fourteen digits. A signature gives each 9 bits: its number from 1 (5 bits), its rounded delay (4 bits).
MOST, BITS = 5, 9
_EPOCH = datetime(1970, 1, 1)
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def rounded_delay(received: np.ndarray, value: np.ndarray) -> np.ndarray:
    """0 for an instant out of the window, 1 for one after arrival, then 2 for a delay below a day, 3 below 3 days, 4 below 7 and so on, doubling."""
    delay = received - value
    days = np.maximum(delay, 0) / DAY_US
    return np.where(np.abs(delay) > WINDOW_US, 0, np.where(delay < 0, 1, 2 + np.log2(1 + days).astype(np.int64)))


def likelihood(rounded: np.ndarray) -> np.ndarray:
    return np.where(rounded == 0, 0.0, np.where(rounded == 1, AFTER, 0.5 ** (np.maximum(rounded, 2) - 2.0)))


class Zone:
    """Offsets of wall-clock readings in one IANA zone, from its transitions."""

    def __init__(self, name: str):
        self.zone = ZoneInfo(name)
        self.low = self.high = 0
        self.first = self.second = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)

    def _offset(self, at: int) -> int:
        return round((datetime.fromtimestamp(at, UTC).astimezone(self.zone)).utcoffset() / timedelta(seconds=1))

    def _cover(self, low: int, high: int) -> None:
        """Finds the transitions between two times in epoch seconds: days are compared, then halved."""
        days = range(low, high + 86_400, 86_400)
        seen = [self._offset(t) for t in days]
        at, offsets = [], [seen[0]]
        for t, a, b in zip(days, seen, seen[1:]):
            if a != b:
                lo, hi = t, t + 86_400
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (lo, mid) if self._offset(mid) != a else (mid, hi)
                at.append(hi)
                offsets.append(b)
        when, offsets = np.array(at, np.int64), np.array(offsets, np.int64)
        walls = np.stack([when + offsets[:-1], when + offsets[1:]]) if len(at) else np.zeros((2, 0), np.int64)
        self.low, self.high, self.offsets = low, high, offsets
        # From which wall-clock second the new offset holds for the first and for the second occurrence of a reading.
        self.first, self.second = walls.max(0), walls.min(0)

    def instants(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second instant of wall-clock readings (microseconds), and which have a second. A skipped reading is taken with the offset before the change."""
        if not len(wall):
            return wall, wall, np.zeros(0, bool)
        seconds = wall // 1_000_000
        low, high = int(seconds.min()) - 3 * 86_400, int(seconds.max()) + 3 * 86_400
        if not self.high or low < self.low or high > self.high:
            # To the month, so that one batch after the other does not search again; to the calendar's ends at most.
            first, last = -62_135_000_000, 253_402_000_000
            self._cover(max(first, min(low - 30 * 86_400, self.low or low)), min(last, max(high + 30 * 86_400, self.high)))
        one = self.offsets[np.searchsorted(self.first, seconds, "right")]
        two = self.offsets[np.searchsorted(self.second, seconds, "right")]
        return wall - one * 1_000_000, wall - two * 1_000_000, two < one


def _whole(column: pa.Array) -> np.ndarray:
    """Digits as numbers, an empty text as 0."""
    return pc.cast(pc.if_else(pc.equal(column, ""), "0", column), pa.int64()).to_numpy(zero_copy_only=False)


def _fraction(column: pa.Array) -> np.ndarray:
    """Digits after the point as microseconds, cut."""
    return _whole(pc.utf8_slice_codeunits(pc.utf8_rpad(column, 6, "0"), 0, 6))


def wall_us(y, mo, d, h, mi, s, us) -> tuple[np.ndarray, np.ndarray]:
    """Microseconds of wall-clock readings since 1970, as if in UTC, and which readings exist."""
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    length = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(mo, 0, 12)] + (leap & (mo == 2))
    exists = (y >= 1) & (y <= 9999) & (mo >= 1) & (mo <= 12) & (d >= 1) & (d <= length) & (h < 24) & (mi < 60) & (s < 60)
    month = np.datetime64("1970-01", "M") + np.where(exists, (y - 1970) * 12 + mo - 1, 0).astype("timedelta64[M]")
    days = month.astype("datetime64[D]").astype(np.int64) + np.where(exists, d - 1, 0)
    return ((days * 24 + h) * 60 + mi) * 60_000_000 + s * 1_000_000 + us, exists


class Readings:
    """The readings of a batch of texts: for each text up to MOST components with their instants and rounded delays."""

    def __init__(self, received: np.ndarray):
        n = len(received)
        self.received, self.count = received, np.zeros(n, np.int64)
        self.component, self.delay, self.instant = np.zeros((n, MOST), np.int64), np.zeros((n, MOST), np.int64), np.zeros((n, MOST), np.int64)

    def add(self, rows: np.ndarray, component: np.ndarray, value: np.ndarray, possible: np.ndarray) -> None:
        at = self.count[rows]
        self.component[rows, at] = component + 1
        self.delay[rows, at] = np.where(possible, rounded_delay(self.received[rows], np.where(possible, value, 0)), 0)
        self.instant[rows, at] = np.where(possible, value, 0)
        self.count[rows] += 1

    def signature(self) -> np.ndarray:
        code = self.component << 4 | self.delay
        return (code << (np.arange(MOST) * BITS)).sum(1)


def _numbers(t: pa.Array, rows: np.ndarray, out: Readings) -> None:
    found = pc.extract_regex(t, _PLAIN)
    plain = found.is_valid().to_numpy(zero_copy_only=False)
    digits = found.filter(pa.array(plain))
    whole, micro = _whole(digits.field("i")), _fraction(digits.field("f"))
    fourteen = pc.match_substring_regex(t, r"^\d{14}$").to_numpy(zero_copy_only=False)
    odd = [Decimal(x) for x in t.filter(pa.array(~plain)).to_pylist()]  # signs, exponents and more digits
    for name, power in UNITS.items():
        value, possible = np.zeros(len(rows), np.int64), ~fourteen
        fits = whole < 9 * 10 ** (18 - max(power, 0))
        scaled = np.where(fits, whole, 0)
        value[plain] = scaled // 1000 if power < 0 else scaled * 10**power + micro // 10 ** (6 - power)
        possible[plain] &= fits
        for i, x in zip(np.flatnonzero(~plain), odd):
            exact = int((x.scaleb(power)).to_integral_value("ROUND_FLOOR")) if abs(x.adjusted()) < 30 else _HIGH
            possible[i] = abs(exact) < 9 * 10**18
            value[i] = exact if possible[i] else 0
        out.add(rows, np.full(len(rows), _NUMBER_OF[name, "site"]), value, possible)


def _dates(name: str, found: pa.StructArray, rows: np.ndarray, out: Readings, zones: list[Zone | None], zone_of: np.ndarray, order: np.ndarray, abbreviations: dict[str, int]) -> None:
    fields = {f.name for f in found.type}
    col = lambda c: found.field(c) if c in fields else pa.array([""] * len(rows), pa.string())
    good = np.ones(len(rows), bool)
    month = _whole(col("m"))
    if "mon" in fields:
        names = pc.index_in(pc.utf8_lower(col("mon")), value_set=pa.array(list(MONTHS)))
        month = np.array([*MONTHS.values(), 0])[pc.fill_null(names, len(MONTHS)).to_numpy(zero_copy_only=False)]
        good &= month > 0
    if "wd" in fields:
        day_name = pc.utf8_lower(col("wd"))
        good &= pc.or_(pc.equal(day_name, ""), pc.is_in(day_name, value_set=pa.array(DAYS))).to_numpy(zero_copy_only=False)
    hour = _whole(col("h"))
    if "ap" in fields:
        half = pc.utf8_lower(col("ap"))
        twelve = pc.not_equal(half, "").to_numpy(zero_copy_only=False)
        good &= ~twelve | (hour >= 1) & (hour <= 12)
        hour = np.where(twelve, hour % 12 + 12 * pc.equal(half, "pm").to_numpy(zero_copy_only=False), hour)
    off = pc.replace_substring(col("off"), ":", "")
    has_off = pc.not_equal(off, "").to_numpy(zero_copy_only=False)
    hours, minutes = _whole(pc.utf8_slice_codeunits(off, 1, 3)), _whole(pc.utf8_slice_codeunits(off, 3, 5))
    good &= (hours <= 18) & (minutes <= 59)
    offset = np.where(pc.starts_with(off, "-").to_numpy(zero_copy_only=False), -1, 1) * (hours * 60 + minutes)
    abbr = pc.utf8_upper(col("abbr"))
    has_abbr = pc.not_equal(abbr, "").to_numpy(zero_copy_only=False)
    known = {**abbreviations, "Z": 0}
    which = pc.fill_null(pc.index_in(abbr, value_set=pa.array(list(known), pa.string())), len(known)).to_numpy(zero_copy_only=False)
    good &= ~has_abbr | (which < len(known))
    offset = np.where(has_abbr, np.array([*known.values(), 0])[which], offset)
    told = has_off | has_abbr
    good &= told | np.array([z is not None for z in zones])[zone_of[rows]]
    us, clock = _fraction(col("f")), (hour, _whole(col("mi")), _whole(col("s")))
    day = _whole(col("d"))
    orders = (("dmy", day, month), ("mdy", month, day)) if name == "slashed" else ((name, day, month),)
    here = out.received[rows].astype("datetime64[us]").astype("datetime64[Y]").astype(np.int64) + 1970
    years = [_whole(col("y"))] if "y" in fields else [here + k for k in range(-2, 3)]
    for notation, d, m in orders:
        before, after, any_ = np.full(len(rows), _LOW), np.full(len(rows), _HIGH), np.zeros(len(rows), bool)
        for y in years:
            wall, exists = wall_us(y, m, d, *clock, us)
            exists &= good
            # Further away than the window, whatever the zone: no zone has to be searched there.
            exists_near = exists & (np.abs(out.received[rows] - wall) <= WINDOW_US + 2 * DAY_US)
            any_ |= exists
            for value, fits in _occurrences(wall, exists_near, told, offset, zones, zone_of[rows]):
                delay = out.received[rows] - value
                fits = fits & (np.abs(delay) <= WINDOW_US)
                before = np.where(fits & (delay >= 0), np.maximum(before, value), before)
                after = np.where(fits & (delay < 0), np.minimum(after, value), after)
        value = np.where(before > _LOW, before, after)
        possible = value < _HIGH
        if name == "slashed":
            possible &= (order[rows] == "") | (order[rows] == notation)
        number = np.where(told, _NUMBER_OF[notation, "text"], _NUMBER_OF[notation, "site"])
        out.add(rows[any_], number[any_], np.where(possible, value, 0)[any_], possible[any_])


def _occurrences(wall, exists, told, offset, zones, zone_of) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    one = np.where(told, wall - offset * 60_000_000, 0)
    two, twice = np.zeros_like(wall), np.zeros(len(wall), bool)
    local = exists & ~told
    for k in np.unique(zone_of[local]):
        at = np.flatnonzero(local & (zone_of == k))
        one[at], two[at], twice[at] = zones[k].instants(wall[at])
    yield one, exists
    yield two, exists & twice


def read(texts: pa.Array, received: np.ndarray, zones: list[Zone | None], zone_of: np.ndarray, order: np.ndarray, abbreviations: dict[str, int]) -> Readings:
    """Every reading of each text; order is '', 'dmy' or 'mdy' as declared by its source, zone_of the place of its source's zone in `zones`."""
    out, t, rest = Readings(received), pc.utf8_trim_whitespace(texts), np.arange(len(texts))
    number = pc.match_substring_regex(t, _NUMBER).to_numpy(zero_copy_only=False)
    if number.any():
        _numbers(t.filter(pa.array(number)), rest[number], out)
    packed = number & pc.match_substring_regex(t, r"^\d{14}$").to_numpy(zero_copy_only=False)
    rest = rest[~number | packed]
    for name, pattern in PATTERNS.items():
        if not len(rest):
            break
        found = pc.extract_regex(t.take(pa.array(rest)), f"^(?:{pattern})$")
        fits = found.is_valid().to_numpy(zero_copy_only=False)
        if fits.any():
            _dates(name, found.filter(pa.array(fits)), rest[fits], out, zones, zone_of, order, abbreviations)
            rest = rest[~fits]
    return out


_READ = "record_id long, exporter_id long, signature long, instants array<long>"


def _parse(batches: Iterator[pa.RecordBatch], abbreviations: dict[str, int]) -> Iterator[pa.RecordBatch]:
    place: dict[str | None, int] = {}
    zones: list[Zone | None] = []
    for b in batches:
        b = b.filter(pc.and_(pc.is_valid(b.column(2)), pc.is_valid(b.column(3))))
        named = b.column(4).dictionary_encode()
        for name in [*named.dictionary.to_pylist(), None]:
            if name not in place:
                place[name] = len(zones)
                try:
                    zones.append(Zone(name) if name else None)
                except Exception:  # not a zone's name
                    zones.append(None)
        codes = np.array([*(place[n] for n in named.dictionary.to_pylist()), place[None]])
        zone_of = codes[pc.fill_null(named.indices, len(codes) - 1).to_numpy(zero_copy_only=False)]
        known = pc.is_in(b.column(5), value_set=pa.array(["dmy", "mdy"]))
        order = np.asarray(pc.if_else(known, b.column(5), "").to_pylist(), dtype="U3")
        r = read(b.column(3), b.column(2).to_numpy(zero_copy_only=False), zones, zone_of, order, abbreviations)
        keep = np.flatnonzero(r.delay.any(1))
        count = r.count[keep]
        held = np.arange(MOST) < count[:, None]
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(r.instant[keep][held]))
        at = pa.array(keep)
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(r.signature()[keep]), lists], ["record_id", "exporter_id", "signature", "instants"])


def unpack(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components, -1 where there is none; rounded delays), a row a signature."""
    code = (signatures[:, None] >> (np.arange(MOST) * BITS)) & ((1 << BITS) - 1)
    return (code >> 4) - 1, code & 15


def fit(component: np.ndarray, like: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Mixture weights of a source's components: component and like have a row for each kind of record (likelihood 0 is impossible), n counts the records."""
    used = np.unique(component[component >= 0])
    weight = np.zeros(len(COMPONENTS))
    weight[used] = 1.0 / max(1, len(used))
    for _ in range(rounds):
        share = weight[component] * like
        share *= (n / share.sum(1))[:, None]
        mass = np.bincount(component[like > 0], share[like > 0], len(COMPONENTS))
        mass[used] += 1.0  # as if each had been seen once: few records decide nothing
        new = mass / mass.sum()
        moved = np.abs(new - weight).max()
        weight = new
        if moved < 1e-9:
            break
    return weight


_CHOICE = "exporter_id long, signature long, best int, notation string, posterior double, ambiguous boolean, readings int, possible int"


def _choose(table: pa.Table) -> pa.Table:
    """The chosen reading of each kind of record of one source."""
    signature, n = table.column("signature").to_numpy(), table.column("n").to_numpy().astype(float)
    component, rounded = unpack(signature)
    like = np.where(component >= 0, likelihood(rounded), 0.0)
    post = fit(component, like, n)[component] * like
    post /= post.sum(1)[:, None]
    best = post.argmax(1)
    chosen = component[np.arange(len(best)), best]
    top = post[np.arange(len(best)), best]
    return pa.table({
        "exporter_id": table.column("exporter_id"), "signature": signature, "best": pa.array(best, pa.int32()), "notation": pa.array([COMPONENTS[c][0] for c in chosen], pa.string()), "posterior": top,
        "ambiguous": 1 - top > DOUBT, "readings": pa.array((component >= 0).sum(1), pa.int32()), "possible": pa.array((like > 0).sum(1), pa.int32()),
    })


def normalized(raw_starts: DataFrame, exporters: DataFrame, zone_abbreviations: DataFrame) -> DataFrame:
    """Rows (record_id, exporter_id, epoch_us, notation, posterior, ambiguous, readings, possible) for each record whose text names an instant.

    Null, empty and senseless texts, incomplete or impossible dates and times,
    local times without a zone and instants more than 400 days from arrival give
    no row, and so do records without received_at. A record of an unknown or
    null exporter is read as of one without zone and date order. readings counts
    the components the text can be read as, possible those whose likelihood is
    not 0; ambiguous marks that the others keep more than DOUBT of the
    posterior. Records repeat as they repeat in the input.
    """
    # A registry of abbreviations; its size is checked before it goes to the driver.
    registry = zone_abbreviations.where("abbreviation is not null and offset_minutes is not null").select(F.upper(F.trim("abbreviation")).alias("a"), F.col("offset_minutes").cast("long").alias("m"))
    rows = registry.limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("more than 10 000 zone abbreviations")
    abbreviations = {r.a: r.m for r in rows}
    places = exporters.where("exporter_id is not null").groupBy("exporter_id").agg(F.min("time_zone").alias("time_zone"), F.min(F.lower(F.trim("date_order"))).alias("date_order"))
    micros = F.unix_micros(F.col("received_at").cast("timestamp"))
    told = raw_starts.select(F.col("record_id").cast("long"), F.col("exporter_id").cast("long"), micros.alias("received_us"), F.col("start_text").cast("string")).join(small(places), "exporter_id", "left")
    told = told.select("record_id", "exporter_id", "received_us", "start_text", "time_zone", "date_order")
    found = cut(told.mapInArrow(lambda it: _parse(it, abbreviations), _READ))
    # A source's records enter the fit as counts by signature: the signatures are bounded by the components and the rounded delays.
    counts = found.groupBy("exporter_id", "signature").agg(F.count(F.lit(1)).alias("n"))
    chosen = cut(counts.groupBy("exporter_id").applyInArrow(_choose, _CHOICE)).withColumnsRenamed({"exporter_id": "_e", "signature": "_s"})
    met = found.join(small(chosen), F.col("exporter_id").eqNullSafe(F.col("_e")) & (F.col("signature") == F.col("_s")))
    return met.select("record_id", "exporter_id", F.element_at("instants", F.col("best") + 1).alias("epoch_us"), "notation", "posterior", "ambiguous", "readings", "possible")


def unit_report(normal: DataFrame) -> DataFrame:
    """Per exporter and notation: records, how many of them more than one component could read, and how many stay ambiguous."""
    return normal.groupBy("exporter_id", "notation").agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("readings") > 1).alias("rival_records"), F.count_if("ambiguous").alias("ambiguous_records"))


def inferred_orders(raw_starts: DataFrame, exporters: DataFrame, zone_abbreviations: DataFrame) -> DataFrame:
    """Per exporter the order of day and month that its records themselves show, whatever is declared: (exporter_id, clear_dmy, clear_mdy, open_dmy, open_mdy, ambiguous_records).

    Counts texts with slashes: clear ones, which only one order can read, and open
    ones by the order the posterior chose. Exporters without such texts have no row.
    """
    found = normalized(raw_starts, exporters.withColumn("date_order", F.lit(None).cast("string")), zone_abbreviations).where(F.col("notation").isin("dmy", "mdy"))
    counts = [F.count_if((F.col("notation") == n) & (F.col("possible") > 1 if kind == "open" else F.col("possible") == 1)).alias(f"{kind}_{n}") for kind in ("clear", "open") for n in ("dmy", "mdy")]
    return found.groupBy("exporter_id").agg(*counts, F.count_if("ambiguous").alias("ambiguous_records"))
