"""Written numbers: cases are written from a value and a notation, so that what a reader must find is known beforehand."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.functions import numbers as N

SPACES = [" ", " ", " "]


def grouped(digits: str, mark: str) -> str:
    """The digits in threes from the right."""
    head = len(digits) % 3 or 3
    return mark.join([digits[:head], *(digits[i : i + 3] for i in range(head, len(digits), 3))])


def written(seed: int):
    """(text, decimal_comma, value or None) over signs, integer sizes, group marks, decimal marks, numbers of decimals and percent signs."""
    rng = random.Random(seed)
    for size, group, mark, places in itertools.product(range(1, 10), ["", ",", ".", *SPACES], ["", ",", "."], range(1, 6)):
        if (group and (size < 4 or group == mark)) or (not mark and places > 1):
            continue
        whole = str(rng.randrange(10 ** (size - 1), 10**size)) if size > 1 else str(rng.randrange(1, 10))
        part = "".join(rng.choice("0123456789") for _ in range(places)) if mark else ""
        text, value = (grouped(whole, group) if group else whole) + mark + part, float(f"{whole}.{part or 0}")
        one_mark = (mark, len(part)) if not group and mark and len(part) == 3 and size <= 3 else (group, 3) if group in (",", ".") and not mark and size <= 6 else None
        for comma in (None, True, False):
            want = value
            if one_mark:  # 1,234 or 1.234: what the mark means hangs on the column
                digits = whole + part
                as_decimal, as_group = float(f"{digits[:-3]}.{digits[-3:]}"), float(digits)
                if one_mark[0] == ",":
                    want = None if comma is None else as_decimal if comma else as_group
                else:
                    want = as_group if comma else as_decimal
            sign, end = rng.choice(["", "-", "−", "+"]), rng.choice(["", "%", " %", " %"])
            yield sign + text + end, comma, None if want is None else -want if sign in ("-", "−") else want


def no_numbers(seed: int):
    """Leading zeros, broken groups, letters and blanks."""
    rng = random.Random(seed)
    digit = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    for space, n in itertools.product(SPACES, (1, 2)):
        yield f"0{digit(n)}{space}{digit(3)}"
    for n in range(1, 5):
        yield from (f"0{digit(n)}", f"{digit(n)}x", f"{digit(1)},{digit(n)},{digit(2)}", f"{digit(n)}.{digit(2)}.{digit(1)}", " " * n, f"{digit(1)}-{digit(n)}")


def test_read_number(spark):
    cases = [*written(7), *((t, c, None) for t in no_numbers(8) for c in (None, True, False))]
    df = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(cases)], "i int, t string, c boolean")
    got = {r.i: r.v for r in df.select("i", N.read_number(F.col("t"), F.col("c")).alias("v")).collect()}
    assert [(t, c, got[i]) for i, (t, c, _) in enumerate(cases)] == cases
    assert [(t, c, N.number_literal(t, c)) for t, c, _ in cases] == cases
    for comma in (None, True, False):
        own = [(t, v) for t, c, v in cases if c is comma]
        assert [r.v for r in spark.createDataFrame([(t,) for t, _ in own], "t string").select(N.read_number(F.col("t"), comma).alias("v")).collect()] == [v for _, v in own]


def test_vote(spark):
    """Cells that show a decimal comma, that show a decimal point, and that show neither, mixed at random."""
    rng = random.Random(5)
    num = lambda n: str(rng.randrange(10 ** (n - 1), 10**n))
    comma = [lambda: f"{num(3)},{num(1)}", lambda: f"{num(2)},{num(2)} %", lambda: f"{num(1)},{num(5)}", lambda: f"{num(2)}.{num(3)},{num(2)}", lambda: f"{num(1)}.{num(3)}.{num(3)}"]
    dot = [lambda: f"{num(3)}.{num(2)}", lambda: f"{num(2)}.{num(4)}", lambda: f"{num(1)},{num(3)}.{num(1)}", lambda: f"-{num(2)},{num(3)},{num(3)}"[1:]]
    neither = [lambda: num(4), lambda: f"{num(2)},{num(3)}", lambda: f"{num(1)}.{num(3)}", lambda: f"{num(1)} {num(3)}", lambda: "n/a", lambda: "", lambda: None]
    rows, want = [], {}
    for g in range(80):
        shown = [kinds for kinds in (comma, dot) if rng.random() < 0.5]
        cells = [rng.choice(kinds)() for kinds in shown] + [rng.choice(neither)() for _ in range(rng.randrange(1, 5))]
        rng.shuffle(cells)
        rows += [(g, c) for c in cells]
        want[g] = None if len(shown) != 1 else shown[0] is comma
    got = spark.createDataFrame(rows, "g int, v string").groupBy("g").agg(N.decimal_comma_vote(F.col("v")).alias("x")).collect()
    assert {r.g: r.x for r in got} == want


def test_readings(spark):
    """A written number means what its marks can mean: groups of three behind one mark are read both ways."""
    rng, cases = random.Random(6), {}
    for size in range(4, 10):
        whole = str(rng.randrange(10 ** (size - 1), 10**size))
        for mark in ",.":
            other = "." if mark == "," else ","
            plain = float(whole)
            cases[grouped(whole, mark)] = {plain, float(f"{whole[:-3]}.{whole[-3:]}")} if size <= 6 else {plain}
            cases[f"{grouped(whole, mark)}{other}25"] = {plain + 0.25}
            cases[f"{grouped(whole, rng.choice(SPACES))}{mark}5"] = {plain + 0.5}
            cases[f"{whole}{mark}75"] = {plain + 0.75}
        cases[grouped(whole, " ")] = cases[whole] = {float(whole)}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", N.readings(F.col("t")).alias("v")).collect()
    assert {r.t: set(r.v) for r in rows} == cases


def test_unsupported_numbers(spark):
    text = "2. Plant Kauppi ran 41 times in 1993 [S2: Row 88]; it used 6 030 litres, 52,25 bars and B7 twice, or 909 otherwise."
    row = spark.createDataFrame([(text,)], "t string").select(N.number_tokens(F.col("t")).alias("all"), N.unsupported_numbers(F.col("t"), F.array(F.lit(6030.0), F.lit(52.25), F.lit(1993.0), F.lit(41.0000001))).alias("bad")).first()
    assert row.bad == ["909"] and {"6 030", "52,25", "41"} <= set(row.all) and "7" not in row.all


def test_csv_safe(spark):
    cells = {"=SUM(B2)": "'=SUM(B2)", "-17": "-17", "-4 %": "-4 %", "+word": "'+word", "@home": "'@home", "word": "word", "-word": "'-word"}
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select("c", N.csv_safe(F.col("c")).alias("s")).collect()
    assert {r.c: r.s for r in rows} == cells
