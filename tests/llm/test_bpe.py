import base64

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from llm_rows import CLASHING, ROWS, documents, empty

from tertulia.llm import bpe, lengths

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def vocabulary(ranks):
    return bpe.vocabulary(ranks, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    ).encode_ordinary


def test_ranks(ranks):
    with open(PATH, "rb") as file:
        token, rank = file.readline().split()
    assert ranks[base64.b64decode(token)] == int(rank)


def test_perfect_hash(ranks):
    keys = sorted(ranks, key=ranks.get)[:5000]
    shift, at = bpe.perfect_hash(keys)
    assert sorted(at) == list(range(len(keys)))  # minimal: every place taken, once


def test_a_missing_byte_is_refused():
    with pytest.raises(ValueError):
        bpe.vocabulary({b"a": 0}, public_tokenizers.PATTERN)


TEXT = st.text(alphabet=list("ab '\n\t\r\x0b\x1c\x85\xa0 　éñ漢１2!?.,\0strdvlm🙂"), max_size=40)


@settings(max_examples=400, deadline=None)
@given(text=TEXT)
def test_ids_are_those_of_the_library(vocabulary, reference, text):
    import numpy as np

    ids = np.frombuffer(bpe.encoder(vocabulary)(text), "<i4")
    assert ids.tolist() == reference(text)
    assert bpe.decode(ids, vocabulary) == text.encode()


def test_full_memory_changes_nothing(vocabulary, reference, monkeypatch):
    import numpy as np

    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    encode = bpe.encoder(vocabulary | {"memo": {}})
    for text in [ROWS[0][1], "a bc, a bc. def ghi jkl", ROWS[0][1]] * 2:
        assert np.frombuffer(encode(text), "<i4").tolist() == reference(text)


def test_edge_rows(spark, vocabulary, reference):
    found = bpe.encoded(documents(spark), vocabulary)
    assert "text" not in found.columns and found.columns[-2:] == ["ids", "decoded"]
    assert set(CLASHING) - {"Score", "ids", "decoded"} < set(found.columns)
    rows = found.select("doc_id", "ids", "decoded").collect()
    assert sorted((r[0] or 0, list(r[1]), bytes(r[2])) for r in rows) == sorted(
        (i or 0, reference(t or ""), (t or "").encode()) for i, t in ROWS
    )


def test_empty(spark, vocabulary):
    assert bpe.encoded(empty(spark), vocabulary).count() == 0


def test_lengths(spark, vocabulary, reference):
    counted = lengths.with_token_count(documents(spark), vocabulary)
    n = [len(reference(t or "")) for _, t in ROWS]
    table = lengths.length_table(counted)
    rows = {r["length"]: r for r in table.collect()}
    assert set(rows) == set(n)
    for x, r in rows.items():
        assert r["docs"] == n.count(x)
        assert r["docs_at_least"] == sum(k >= x for k in n)
        assert r["docs_at_most"] == sum(k <= x for k in n)
        assert r["tokens_at_least"] == sum(k for k in n if k >= x)
        assert r["truncated_tokens"] == sum(min(k, x) for k in n)
    limits = [0, 1, 3, 11, 1024, 10_000, 10**9]
    for r in lengths.at_limits(table, limits).collect():
        assert r["docs_cut"] == sum(k > r["limit"] for k in n)
        assert r["truncated_tokens"] == sum(min(k, r["limit"]) for k in n)
    for q in (0.1, 0.5, 0.99, 1.0):
        assert lengths.quantile(table, q) == sorted(n)[-(-int(q * 1e9) * len(n) // 10**9) - 1]


def test_no_lengths(spark, vocabulary):
    table = lengths.length_table(lengths.with_token_count(empty(spark), vocabulary))
    assert table.count() == 0 and lengths.quantile(table, 0.5) is None


def test_texts_are_encoded_once_for_lengths(spark, vocabulary, monkeypatch):
    stored = []
    keep = lengths.written
    monkeypatch.setattr(lengths, "written", lambda df, name: stored.append(df) or keep(df, name))
    found = lengths.length_table(lengths.with_token_count(documents(spark), vocabulary))
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (found, *stored)]
    assert [p.count("MapInArrow") for p in plans] == [0, 1]


def test_short_pieces_merge_side_by_side(vocabulary, reference):
    """What is merged in one matrix gives the ids of the heap and of the library."""
    import random

    draw = random.Random(5)
    letters = "etaoinshrdlucmfwypvbgkjqxzäöéèß漢&%$#.!"
    words = {"".join(draw.choice(letters) for _ in range(draw.randint(1, 20))) for _ in range(4000)}
    pieces = [p for p in (" " + w for w in sorted(words)) if len(p.encode()) <= bpe.SHORT]
    raws = [p.encode() for p in pieces] + [b"a" * n for n in range(1, bpe.SHORT + 1)]
    found = bpe.merged_side_by_side(raws, vocabulary)
    assert [list(memoryview(x).cast("i")) for x in found] == [bpe.merged(r, vocabulary) for r in raws]
    encode = bpe.texts_encoder(vocabulary | {"memo": {}})
    texts = ["".join(pieces[i::7]) for i in range(7)] + [None, "", "a" * 500]
    assert [list(memoryview(x).cast("i")) for x in encode(texts)] == [reference(t or "") for t in texts]
