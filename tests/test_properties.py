"""Cell functions against Python's own string and number functions on random values."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkscrub.functions import checks, numbers, strings, text

SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
ALPHABET = (
    "abcXYZ 019._-@'\t\n éÉßñÇçğİıŞΣσςЖжäöüÅø日本語한글عربي😀🎉ªº①Ⅷ²" + SPACES + "ǅ́​"
)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(3000)]


@pytest.fixture(scope="module")
def doubles():
    rng = random.Random(11)
    values = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-9, 15) for _ in range(4000)]
    values += [round(rng.uniform(-1000, 1000), rng.randint(0, 4)) for _ in range(4000)]
    values += [float(rng.randint(-(10**6), 10**6)) for _ in range(500)]
    return values + [0.0, -0.0, 0.001, 0.0001, 1e7, 1e15, 9999999.5, 0.5, 1.5, 2.5, 0.285, 1.005]


def _mapped(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(4)
    return [r[1] for r in sorted(df.select("i", expression(F.col("v"))).collect())]


def _same(found, expected, values):
    wrong = [(v, f, e) for v, f, e in zip(values, found, expected) if f != e]
    assert not wrong, (len(wrong), wrong[:5])


def test_white_space_set():
    assert set(text.WHITESPACE) == set(SPACES)


def test_strip(spark, words):
    _same(_mapped(spark, words, "string", text.strip), [w.strip() for w in words], words)


def test_words(spark, words):
    _same(_mapped(spark, words, "string", strings.words), [w.split() for w in words], words)


def test_mask_words(spark, words):
    expected = [" ".join(p[:2] + "*" * (len(p) - 2) for p in w.split()) for w in words]
    _same(_mapped(spark, words, "string", strings.mask_words), expected, words)


def test_mask(spark, words):
    def plain(w):
        k = 2 if len(w) > 4 else 1
        return w if len(w) in (0, 2) else "*" if len(w) == 1 else w[:k] + "*" * (len(w) - 2 * k) + w[-k:]

    found = _mapped(spark, words, "string", lambda c: strings.mask(c, normalize_ints=False))
    _same(found, [plain(w) for w in words], words)


def test_case(spark, words):
    _same(_mapped(spark, words, "string", F.upper), [w.upper() for w in words], words)
    _same(_mapped(spark, words, "string", F.lower), [w.lower() for w in words], words)


def test_title(spark, words):
    # A capital sigma before a combining mark is the one known difference.
    words = [w for w in words if "Σ" not in w]
    _same(_mapped(spark, words, "string", strings.title), [w.title() for w in words], words)


def test_letters(spark, words):
    expected = ["".join(c for c in w if c.isalpha() or c.isspace()) for w in words]
    _same(_mapped(spark, words, "string", strings.keep_letters), expected, words)


def test_float_grammar(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789_.eE+- infa٣") for _ in range(rng.randint(1, 6))) for _ in range(4000)]

    def reads(t):
        try:
            float(t)
            return True
        except ValueError:
            return False

    _same(_mapped(spark, texts, "string", lambda c: c.rlike(text.FLOAT_TEXT)), [reads(t) for t in texts], texts)

    def dropped(t):
        if not reads(t) or not t.isascii():
            return t
        number = float(t)
        return str(int(number)) if abs(number) < 1e37 and number.is_integer() else t

    ascii_texts = [t for t in texts if t.isascii()]
    _same(_mapped(spark, ascii_texts, "string", text.drop_point_zero), list(map(dropped, ascii_texts)), ascii_texts)


def test_number_text(spark, doubles):
    values = [d for d in doubles if abs(d) < 1e16]
    found = _mapped(spark, values, "double", lambda c: text.cell_text(c, T.DoubleType()))
    _same(found, [repr(v) for v in values], values)


def test_short_text(spark, doubles):
    values = [*doubles, 1e16, 3e20, -7e30, 123456789012345678.0]
    found = _mapped(spark, values, "double", lambda c: text.short_text(c, T.DoubleType()))
    _same(found, [str(int(v)) if v.is_integer() else repr(v) for v in values], values)


@pytest.mark.parametrize("decimals", [0, 1, 2, 5, 10])
def test_rounding(spark, doubles, decimals):
    found = _mapped(spark, doubles, "double", lambda c: numbers.round_half_even(c, decimals))
    expected = pd.Series(doubles).round(decimals).tolist()
    wrong = [(v, f, e) for v, f, e in zip(doubles, found, expected) if f != e]
    assert not wrong, wrong[:5]


def test_number_parsing(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789.eE+- xdf") for _ in range(rng.randint(1, 6))) for _ in range(3000)]
    found = _mapped(spark, texts, "string", lambda c: numbers.to_number(c, T.StringType()))
    expected = [None if np.isnan(n) else n for n in pd.to_numeric(pd.Series(texts), errors="coerce").astype(float)]
    wrong = [
        (t, f, e)
        for t, f, e in zip(texts, found, expected)
        if (f is None) != (e is None) or (f is not None and not math.isclose(f, e, rel_tol=1e-14))
    ]
    assert not wrong, wrong[:5]


def test_word_characters(spark):
    """The first character of an address is a letter, digit or underscore of any script."""
    signs = [chr(c) for c in range(0x20, 0x0870) if chr(c) not in SPACES]
    found = _mapped(spark, signs, "string", lambda c: F.concat(c, F.lit("@b.com")).rlike(checks.EMAIL))
    _same(found, [c.isalnum() or c == "_" for c in signs], signs)
