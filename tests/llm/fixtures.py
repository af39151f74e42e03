"""Documents that put every operator to its edge cases."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, h string, row long, ref string"


def sentence(rng: random.Random, n: int, words: list[str]) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def texts(seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("the", "in", "er", "wal", "lo", "que", "sch") for b in ("", "ing", "ed", "ra", "no", "té", "üb")]
    shared = sentence(rng, 60, vocabulary)
    long = "\n".join(sentence(rng, 40, vocabulary) for _ in range(60))
    out: list[str | None] = [None, "", " ", "\n\t", "one", "one two", "One two", "A b c", shared, shared, f"{sentence(rng, 30, vocabulary)} {shared}", f"{shared} {sentence(rng, 30, vocabulary)}", long, long + " x", "x" * 5000, "ab " * 900, "日本語 テキスト 😀 é", "tail  with   runs \n of space  ", "<|endoftext|> inside <|endoftext|>", "a\r\nb\x0bc\x0cd\x1ce\x85f　g"]
    out += [sentence(rng, rng.randint(1, 150), vocabulary) for _ in range(20)]
    out += [out[12].replace("the", "THE", 1), out[8], out[8] + ".", "same line\nsame line\n \nother"]
    return out


def documents(spark, extra=()):
    rows = [(i, t, ["en", "de", None, "fr"][i % 4], ["s1", "s2", None, "Ünï", "s1"][i % 5], None if t is None else len(t), "clash", -1, "clash") for i, t in enumerate([*texts(), *extra])]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


def no_documents(spark):
    return spark.createDataFrame([], COLUMNS)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
