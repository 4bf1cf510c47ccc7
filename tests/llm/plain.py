"""Plain counterparts of the operators, for small inputs, and the rows the tests share."""

from __future__ import annotations

import random
import re

BLANK = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[bytes]:
    return BLANK.findall((text or "").encode())


def low(text: str | None) -> bytes:
    return (text or "").encode().lower()  # A-Z only: these are bytes


def corpus(n: int = 60, seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Texts with exact and near copies, shared passages, empty, null, short and very long ones, odd white space and a missing id."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["The", "the", "É", "naïve", "x,", "don't", "$$$", "1.5"]
    passage = " ".join(rng.choices(vocabulary, k=40))
    rows: list[tuple[int | None, str | None]] = [(1000, None), (1001, ""), (1002, " \t\n "), (1003, "one"), (1004, "One"), (1005, "a b c d"), (1006, "a b c e")]
    base = rng.choices(vocabulary, k=120)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = " ".join(rng.choices(vocabulary, k=rng.randint(5, 150)))
        elif kind == 1:
            own = list(base)
            for _ in range(rng.randint(0, 8)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = " ".join(own)
        elif kind == 2:
            text = " ".join(base)
        elif kind == 3:
            text = " ".join(rng.choices(vocabulary, k=30)) + "\n" + passage + "\t" + " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))
        elif kind == 4:
            text = "\n".join(["same line here and now again"] * rng.randint(1, 5) + [" ".join(rng.choices(vocabulary, k=12))])
        else:
            text = "\x0b".join(rng.choices(vocabulary, k=rng.randint(1, 9)))
        rows.append((i, text))
    rows.append((2000, " ".join(rng.choices(vocabulary, k=9000))))
    rows.append((2001, rows[-1][1]))
    rows.append((None, " ".join(base)))
    return rows


def frame(spark, rows, more: bool = True):
    """Documents with columns whose names the operators use themselves."""
    wide = [(i, t, "en" if (i or 0) % 2 else None, "s", len(t or ""), 1, "z", [5], True) for i, t in rows]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, key int, gone string, keys array<int>, kept boolean"
    df = spark.createDataFrame(wide, kinds)
    return df if more else df.select("doc_id", "text", "lang", "source", "n_chars")
