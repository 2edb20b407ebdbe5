"""CAN frames: signals from payload bits by DBC definitions, as Columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from lapwing.operators.resample import around
from lapwing.sessions import settled


def byte(payload: Column, k: int) -> Column:
    """Byte k of a binary payload as a long; NULL beyond its end."""
    return F.when(F.octet_length(payload) > k, F.conv(F.hex(F.substring(payload, k + 1, 1)), 16, 10).cast("long"))


def bit_places(start: int, length: int, big_endian: bool) -> list[tuple[int, int]]:
    """(byte, bit) of a signal from its least significant bit on.

    Little endian counts up from the start bit. Big endian starts at the most significant bit, goes
    down within a byte and on at bit 7 of the next.
    """
    if not big_endian:
        return [((start + k) // 8, (start + k) % 8) for k in range(length)]
    places, at, bit = [], start // 8, start % 8
    for _ in range(length):
        places.append((at, bit))
        at, bit = (at, bit - 1) if bit else (at + 1, 7)
    return places[::-1]


def raw_value(payload: Column, start: int, length: int, big_endian: bool = False, signed: bool = False) -> Column:
    """The raw integer of a signal; NULL if the payload is too short. Runs of bits of a byte move at once."""
    out, k, places = F.lit(0).cast("long"), 0, bit_places(start, length, big_endian)
    while k < length:
        n = 1
        while k + n < length and places[k + n] == (places[k][0], places[k][1] + n):
            n += 1
        part = F.shiftright(byte(payload, places[k][0]), places[k][1]).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, k))
        k += n
    if signed and length < 64:
        out = F.when(out >= (1 << (length - 1)), out - (1 << length)).otherwise(out)
    return out


def physical(raw: Column, factor: float, offset: float) -> Column:
    return raw * F.lit(factor) + F.lit(offset)


def parse_dbc(lines: DataFrame) -> DataFrame:
    """Signals of DBC text (db, line_no, line): one row per SG_ line with the message above it.

    Bit 31 of an id marks the extended format; the pseudo message 0xC0000000 is skipped.
    """
    msg = r"^\s*BO_\s+(\d+)\s+(\w+)\s*:\s*(\d+)"
    sig = r"^\s*SG_\s+(\w+)\s*(M|m\d+M?)?\s*:\s*(\d+)\|(\d+)@([01])([+-])\s*\(([^,]+),([^)]+)\)\s*\[([^|]*)\|([^\]]*)\]\s*\"([^\"]*)\""
    m = F.when(F.col("line").rlike(msg), F.struct(F.regexp_extract("line", msg, 1).cast("long").alias("id"), F.regexp_extract("line", msg, 2).alias("message"), F.regexp_extract("line", msg, 3).cast("int").alias("size")))
    above = F.last(m, True).over(Window.partitionBy("db").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    g = lambda k: F.regexp_extract("line", sig, k)
    s = lines.withColumn("m", above).where(F.col("line").rlike(sig)).where("m.id <> 3221225472")
    return s.select(
        "db", F.col("m.id").bitwiseAND(F.lit(0x1FFFFFFF)).alias("frame_id"), (F.col("m.id") >= 2147483648).alias("extended"), "m.message", "m.size", g(1).alias("signal"), g(3).cast("int").alias("start_bit"), g(4).cast("int").alias("length"),
        (g(5) == "0").alias("big_endian"), (g(6) == "-").alias("signed"), g(7).cast("double").alias("factor"), g(8).cast("double").alias("offset"), F.expr("try_cast('' AS DOUBLE)").alias("unused"), g(11).alias("unit"),
        F.when(g(2) == "M", "M").when(g(2) != "", "m").alias("mux_role"), F.expr("try_cast(regexp_extract(line, 'm([0-9]+)', 1) AS INT)").alias("mux_digits"),
    ).drop("unused").withColumn("mux_branch", F.when(F.col("mux_role") == "m", F.col("mux_digits"))).drop("mux_digits")


def merge_dbc(signals: DataFrame, frames: DataFrame) -> DataFrame:
    """Union of files; an id defined by several goes to the file whose ids cover more frames, then the first by name."""
    counts = frames.groupBy("frame_id").agg(F.count("*").alias("frames"))
    ids = signals.select("db", "frame_id", "extended").distinct()
    cover = ids.select("db", "frame_id").distinct().join(counts, "frame_id", "left").groupBy("db").agg(F.sum(F.coalesce("frames", F.lit(0))).alias("covered"))
    w = Window.partitionBy("frame_id", "extended").orderBy(F.desc("covered"), "db")
    chosen = ids.join(cover, "db").withColumn("rank", F.row_number().over(w)).where("rank = 1").select("db", "frame_id", "extended")
    return signals.join(chosen, ["db", "frame_id", "extended"], "left_semi")


#: Signals up to which the definitions are broadcast, some 200 bytes each; more are joined by a shuffle.
BROADCAST_SIGNALS = 100_000
SIGNAL = "db string, frame_id long, extended boolean, message string, size int, signal string, start_bit int, length int, big_endian boolean, signed boolean, factor double, offset double, unit string, mux_role string, mux_branch int"


def _as_table(spark: SparkSession, signals: DataFrame | list) -> tuple[DataFrame, int, int]:
    """The definitions as a table, how many signals there are, and how many bits a payload needs for them."""
    if isinstance(signals, DataFrame):
        table = settled(signals, "signals")  # parsed once
        n, most = table.agg(F.count("*"), F.max(_place() + F.col("length"))).first()
        return table, n, most or 0
    names = [c.split()[0] for c in SIGNAL.split(", ")]
    get = lambda s, c: s[c] if c in (s.asDict() if isinstance(s, Row) else s) else None
    ends = [(s["start_bit"] // 8 * 8 + 7 - s["start_bit"] % 8 if s["big_endian"] else s["start_bit"]) + s["length"] for s in signals]
    return spark.createDataFrame([tuple(get(s, c) for c in names) for s in signals], SIGNAL), len(signals), max(ends, default=0)


def _place() -> Column:
    """A signal's first bit, counted from the payload's first: of big endian signals bit 7 of a byte comes first."""
    start = F.col("start_bit")
    return F.when(F.coalesce("big_endian", F.lit(False)), F.floor(start / 8) * 8 + 7 - start % 8).otherwise(start).cast("int")


def messages(signals: DataFrame) -> DataFrame:
    """(frame_id, extended, message, selector, signals): what to do with a frame of an id and format, as data.

    A signal's bits come from two neighbouring 64-bit words of the payload (in the byte order of the signal): each is
    shifted, both are joined and cut to the length. A frame belongs to the message of its id and format, and where
    only the other format has its id, to that. A signal in several messages carries its message's name.
    """
    n, big, place = F.col("length"), F.coalesce("big_endian", F.lit(False)), _place()
    at = signals.select("*", F.floor(place / 64).cast("int").alias("word"), (place % 64).alias("off")).withColumn("over", F.col("off") + n - 64)
    spans, off, over = F.col("over") > 0, F.col("off"), F.col("over")
    zero = F.lit(0)
    named = at.withColumn("n_named", F.count("*").over(Window.partitionBy("signal")))
    how = F.struct(
        F.when(F.col("n_named") == 1, F.col("signal")).otherwise(F.concat_ws(".", "message", "signal")).alias("channel"), big.alias("big"), "word", spans.alias("spans"),
        F.when(big, F.greatest(zero, -over)).otherwise(off).alias("right"), F.when(big & spans, over).otherwise(zero).alias("left"),
        F.when(big, zero).otherwise(64 - off).alias("left2"), F.when(big, 64 - over).otherwise(zero).alias("right2"),
        n.alias("length"), F.coalesce("signed", F.lit(False)).alias("signed"), F.ceil((place + n) / 8).cast("int").alias("bytes"), F.col("factor").cast("double").alias("factor"), F.col("offset").cast("double").alias("offset"),
        F.when(F.col("mux_role") == "m", F.coalesce(F.col("mux_branch"), F.lit(-1))).alias("branch"),
    )
    one = named.select("frame_id", F.coalesce("extended", F.lit(False)).alias("extended"), "message", how.alias("how"), (F.col("mux_role") == "M").alias("selects"))
    whole = one.groupBy("frame_id", "extended").agg(F.min("message").alias("message"), F.min_by("how", F.when(F.col("selects"), F.col("how.channel"))).alias("selector"), F.collect_list("how").alias("signals"))
    both = whole.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("format"))
    first = F.row_number().over(Window.partitionBy("frame_id", "format").orderBy(F.col("format") != F.col("extended")))
    return both.withColumn("nth", first).where("nth = 1").select("frame_id", F.col("format").alias("extended"), "message", "selector", "signals")


def _words(payload: Column, words: int) -> dict[str, Column]:
    """The payload as 64-bit words, missing bytes as 0: high byte first, and low byte first."""
    text = lambda k: F.rpad(F.substring(F.hex(payload), 16 * k + 1, 16), 16, "0")
    high = [F.conv(text(k), 16, -10).cast("long") for k in range(words)]
    return {f"__b{k}": w for k, w in enumerate(high)}


def _swapped(word: str) -> str:
    return " | ".join(f"shiftleft(shiftrightunsigned({word}, {8 * k}) & 255L, {56 - 8 * k})" for k in range(8))


def _value(how: str, words: int) -> str:
    """SQL of the raw value of a signal `how`, null where the payload is too short."""
    pick = lambda step: (
        f"if({how}.big, __b0, __l0)" if words == 1 and not step else "0L" if words == 1 else f"coalesce(get(if({how}.big, __b, __l), {how}.word + {step}), 0L)"
    )
    bits = f"shiftleft(shiftrightunsigned({pick(0)}, {how}.right), {how}.left)"
    if words > 1:
        bits = f"({bits} | if({how}.spans, shiftrightunsigned(shiftleft({pick(1)}, {how}.left2), {how}.right2), 0L))"
    top = f"shiftleft({bits}, 64 - {how}.length)"
    cut = f"if({how}.signed, shiftright({top}, 64 - {how}.length), shiftrightunsigned({top}, 64 - {how}.length))"
    return f"if(octet_length(payload) >= {how}.bytes, {cut}, NULL)"


def matched(frames: DataFrame, signals: DataFrame | list) -> DataFrame:
    """Frames with their message, `selected` (the selector's raw value, null without one) and `signals`; frames of no message are left out."""
    table, n, most = _as_table(frames.sparkSession, signals)
    words = 1 if most <= 64 else 8
    defined = messages(table)
    defined = F.broadcast(defined) if n <= BROADCAST_SIGNALS else defined
    known = frames.withColumn("extended", F.coalesce("extended", F.lit(False)) if "extended" in frames.columns else F.lit(False)).join(defined, ["frame_id", "extended"])
    known = known.withColumns(_words(F.col("payload"), words)).withColumns({f"__l{k}": F.expr(_swapped(f"__b{k}")) for k in range(words)})
    if words > 1:
        known = known.withColumns({"__b": F.array(*(f"__b{k}" for k in range(words))), "__l": F.array(*(f"__l{k}" for k in range(words)))})
    return known.withColumn("selected", F.when(F.col("selector").isNotNull(), F.expr(_value("selector", words))))


def decode(frames: DataFrame, signals: DataFrame | list) -> DataFrame:
    """(session_id, t, seq, channel, v) of frames (session_id, t, seq, frame_id, extended, payload).

    `signals` is a table as `parse_dbc` gives it, or its rows. A frame meets its own message's signals only, by a join,
    so the work of a frame doesn't grow with the number of definitions. Signals of a branch need the selector's value;
    without a selector in the message they have none. Payloads of up to 64 bytes; a signal beyond the payload's end has no value.
    """
    got = matched(frames, signals)
    words = 8 if "__b" in got.columns else 1
    mine = F.filter("signals", lambda s: s["branch"].isNull() | (s["branch"] == F.col("selected")))
    one = got.withColumn("s", F.explode(mine)).withColumn("raw", F.expr(_value("s", words)))
    number = F.when((F.col("s.length") == 64) & ~F.col("s.signed") & (F.col("raw") < 0), F.col("raw") + F.lit(2.0**64)).otherwise(F.col("raw"))
    return one.select("session_id", "t", "seq", "s.channel", (number * F.col("s.factor") + F.col("s.offset")).alias("v")).where("v IS NOT NULL")


def stray_selectors(frames: DataFrame, signals: DataFrame | list) -> DataFrame:
    """(message, selected, frames): how many frames have a selector value that no branch of their message has."""
    got = matched(frames, signals).where("selected IS NOT NULL AND exists(signals, s -> s.branch IS NOT NULL)")
    return got.where(~F.exists("signals", lambda s: F.coalesce(s["branch"] == F.col("selected"), F.lit(False)))).groupBy("message", "selected").agg(F.count("*").alias("frames"))


def on_axis(decoded: DataFrame, axis: DataFrame, block: float | None = None) -> DataFrame:
    """(session_id, t, channel, v): each channel's last value at each time of the axis (session_id, t); before its first value, that one.

    Of several values at one time the last by `seq` counts.
    """
    last = decoded.groupBy("session_id", "channel", "t").agg(F.max_by("v", "seq").alias("v"))
    key = F.struct("session_id", "channel")
    heads = last.groupBy("session_id", "channel").agg(F.min_by("v", "t").alias("first"))
    left = axis.select("session_id", "t").join(heads, "session_id").select(key.alias("session_id"), "t", "first")
    held = around(left, last.select(key.alias("session_id"), "t", "v"), block=block, sides=("prev",))
    return held.select("session_id.session_id", "t", "session_id.channel", F.coalesce("prev.v", "first").alias("v"))


def undecoded(frames: DataFrame, signals: DataFrame) -> DataFrame:
    """Ids that no DBC knows: count, rate and a sample payload."""
    left = frames.join(signals.select("frame_id").distinct(), "frame_id", "left_anti")
    span = F.max("t") - F.min("t")
    return left.groupBy("frame_id").agg(F.count("*").alias("frames"), F.when(span > 0, (F.count("*") - 1) / span).alias("rate"), F.min_by(F.hex("payload"), F.struct("t", "seq")).alias("sample"))
