"""Queries whose twins hold for letters and marks beyond ASCII only, against plain Python on every kind of text."""

import re

import pytest

from proofmill.functions.text import STOP_WORDS
from proofmill.plans.catalogue import QUERIES
from tests.oracle_check import plain

TEXTS = [
    "Le café de 12 élèves", "naïve 3.5 größe 2024-01-02 über", "été 7é x7 ٣٤ 99", "日本語 2024年 12:30 テスト eu-west-1-a", "плюс 5 минус", "plain ascii 42",
    None, "", "éa b-c-3-d 1.2.3", "mot—mot 10—20 d’été", "Ünï 0 café 8", "x " * 40 + "ñandú 1.", "ascii 1 again",
]
#: Tokens that may not be lost, in the words of Python's expressions.
CRITICAL = (r"\b\d+\.?\d*\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d+\.\d+\.\d+\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b", r"\b[a-z]+-[a-z]+-\d+-[a-z]+\b")


def altered(t, k):
    return [t, t + " zzunheard newword", t + " 987654321", re.sub("[0-9]", "", t), t[: len(t) // 2], ""][k % 6]


def words(t):
    return set(re.findall(r"\b[a-zA-Z]+\b", t.lower()))


def numbers(t):
    return set(re.findall(CRITICAL[0], t))


def critical(t):
    return {x for p in CRITICAL for x in re.findall(p, t)}


def added(raw, cleaned, least):
    return sorted(w for w in words(cleaned) - words(raw) - set(STOP_WORDS) if len(w) >= least) if raw else []


def safeguard(raw, cleaned):
    grown = (len(cleaned) - len(raw)) / len(raw) * 100 if raw and len(cleaned) > len(raw) else 0.0
    more = sorted(numbers(cleaned) - numbers(raw)) if raw else []
    return ",".join(added(raw, cleaned, 3)), ",".join(more), round(grown, 6), bool(raw and not cleaned), grown > 20


def guardrails(raw, cleaned):
    if raw and not cleaned:
        return False, "empty_cleaned_from_nonempty_raw"
    grown = safeguard(raw, cleaned)[2]
    found = [("added_numbers", raw and numbers(cleaned) - numbers(raw)), ("added_words", added(raw, cleaned, 4)), ("critical_token_loss", critical(raw) - critical(cleaned)), ("excessive_expansion", grown > 20), ("excessive_compression", raw and (len(raw) - len(cleaned)) / len(raw) > 0.3)]
    kinds = ",".join(name for name, on in found if on)
    return not kinds, kinds


def tokens(raw, _):
    return len(critical(raw)), " ".join(sorted(critical(raw)))


@pytest.mark.parametrize(("name", "spec"), [("safeguard", safeguard), ("guardrail_results", guardrails), ("critical_tokens", tokens)])
def test_every_text_is_checked(spark, tmp_path, name, spec):
    rows = [(k * 6 + j, t) for k, t in enumerate(TEXTS) for j in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(map(plain, r[1:])) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {i: tuple(map(plain, spec(t or "", altered(t or "", i)))) for i, t in rows}
