import pytest

from sojourn import schema as S
from sojourn.operators import curate, vocab


@pytest.fixture
def words(events):
    rows = events((1, 0.0, "CDzz9"), (1, 1.0, "CDzz10"), (2, 0.0, None), (2, 0.0, ""))
    return vocab.vocabulary(rows)


def test_blocks_and_ids(words):
    ids = {r["token"]: r["token_id"] for r in words.collect()}
    fixed = sorted([*S.GAP_DAYS, "DUMMY"]) + [f"Q{i}" for i in range(10)] + sorted(S.VISIT_GROUPS)
    order = fixed + ["CDzz10", "CDzz9", "<unk>", "<s>", "</s>", "<pad>"]
    assert len(S.GAP_DAYS) == 38
    assert ids == {t: i for i, t in enumerate(order)}


def test_encode_and_decode(texts, words):
    ids = {r["token"]: r["token_id"] for r in words.collect()}
    rows = texts((1, "CDzz9 TIME_D_1 CDzz-x Other CDzz10"), (2, ""))
    got = {r["subject_id"]: r for r in vocab.encode(rows, words).collect()}
    unk = ids["<unk>"]
    want = [ids["CDzz9"], ids["TIME_D_1"], unk, unk, unk, unk, ids["CDzz10"]]
    assert got[1]["input_ids"] == want and got[1]["attention_mask"] == [1] * 7
    assert got[2]["input_ids"] == []
    back = {r["subject_id"]: r["text"] for r in vocab.decode(vocab.encode(rows, words), words).collect()}
    assert back[1] == "CDzz9 TIME_D_1 CDzz10"


@pytest.mark.parametrize("limit", [10_000, 3])
def test_decoding_moves_no_tokens(spark, words, monkeypatch, limit):
    monkeypatch.setattr(vocab, "LISTED_TOKENS", limit)
    ids = {r["token"]: r["token_id"] for r in words.collect()}
    rows = spark.createDataFrame(
        [
            (1, [ids["CDzz9"], ids["<pad>"], 10**12, ids["Q3"], -1, ids["<unk>"], ids["CDzz10"]]),
            (2, [ids["</s>"]]),
            (3, []),
            (4, None),
            (5, [None, ids["VIER"], ids["VIER"]]),
        ],
        "subject_id bigint, input_ids array<bigint>",
    )
    back = vocab.decode(rows, words)
    assert {r["subject_id"]: r["text"] for r in back.collect()} == {
        1: "CDzz9 Q3 CDzz10",
        2: "",
        5: "VIER VIER",
    }
    if limit > 3:
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert not any(step in plan for step in ("Generate", "Exchange", "Aggregate"))


def test_decoding_by_ids_with_gaps(spark):
    words = spark.createDataFrame([("a", 0), ("b", 7), ("it's", 3)], "token string, token_id bigint")
    rows = spark.createDataFrame([(1, [7, 3, 0, 5])], "subject_id bigint, input_ids array<bigint>")
    assert vocab.decode(rows, words).first()["text"] == "b it's a"


def test_padding_and_end_token(texts, words):
    ids = {r["token"]: r["token_id"] for r in words.collect()}
    rows = texts((1, "CDzz9 CDzz10"), (2, "CDzz9 CDzz9 CDzz10 CDzz9 CDzz9"))
    made = vocab.encode(rows, words, add_eos=True, pad_to=4)
    got = {r["subject_id"]: r for r in made.collect()}
    a, b, pad, eos = ids["CDzz9"], ids["CDzz10"], ids["<pad>"], ids["</s>"]
    assert got[1]["input_ids"] == [pad, a, b, eos] and got[1]["attention_mask"] == [0, 1, 1, 1]
    assert got[2]["input_ids"] == [a, a, b, a] and got[2]["attention_mask"] == [1] * 4
    bare = vocab.encode(rows, words, keep_text=False)
    assert bare.columns == ["input_ids", "attention_mask"]


CODES = ["CDzz9", "CD-zz 1", " lead", "tail ", "two  gaps", "", None, "\t", "é+ü", "VIER", "<unk>", " "]


@pytest.fixture
def odd_events(events):
    """Codes with spaces, signs and nothing at all, at every place of a visit."""
    rows = []
    for s in range(1, 6):
        for i, code in enumerate(CODES[s:] + CODES[:s]):
            value = float(i) if i % 3 else None
            visit = s * 100 + i // 4 if i % 5 else None
            rows.append((s, i * 40000.0 * s, code, value, visit, ["Office Visit", "Inpatient", None][s % 3]))
    return events(*rows, (6, 0.0, "", None, None, None), (None, 0.0, "CDzz9", None, None, None))


@pytest.mark.parametrize("max_tokens", [3, 7, 2048])
def test_event_ids_equal_those_of_the_texts(odd_events, max_tokens):
    _, rows, words = curate.curated_ids(odd_events, None, max_tokens)
    ids = vocab.special_ids(words)
    got = {r["subject_id"]: r for r in vocab.finished(rows, "flatten(word_ids)", ids).collect()}
    texts = rows.select("subject_id", "text")
    want = {r["subject_id"]: r for r in vocab.encode(texts.where("subject_id > 0"), words).collect()}
    assert len(got) == 7 and len(want) == 6
    for subject, row in want.items():
        assert got[subject]["text"] == row["text"]
        assert got[subject]["input_ids"] == row["input_ids"], row["text"]
        assert len(got[subject]["word_ids"]) == len(row["text"].split(" "))
    cut = curate.sequences(odd_events, None, max_tokens)
    assert {(r[0], r[1]) for r in cut.collect()} == {(s, r["text"]) for s, r in got.items()}


def test_encoded_sequences_move_no_tokens(odd_events):
    """From the events on there is one exchange, by subject, as for the texts alone."""
    moved = {}
    for name, rows in [
        ("ids", curate.curated_ids(odd_events, None)[1]),
        ("texts", curate.curated(odd_events, None)[1]),
    ]:
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan
        moved[name] = rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert moved == {"ids": 1, "texts": 1}


def test_ids_of_no_events(events):
    _, rows, words = curate.curated_ids(events(), None)
    assert rows.count() == 0 and words.count() > 60


def test_unknown_tokens(texts, words):
    rows = texts((1, "CDzz9 new <unk> new"), (2, "CDzz10"))
    got = {(r["subject_id"], r["token"], r["n"]) for r in vocab.unknown_tokens(rows, words).collect()}
    assert got == {(1, "new", 2), (1, "<", 1), (1, "unk", 1), (1, ">", 1)}


@pytest.fixture
def encoded(spark):
    rows = [(i, list(range(10, 10 + n))) for i, n in enumerate([3, 1, 5, 2, 4])]
    return spark.createDataFrame(rows, "subject_id bigint, input_ids array<bigint>")


def test_last_tokens(encoded):
    got = [r[0] for r in encoded.orderBy("subject_id").selectExpr(vocab.last_tokens("input_ids", 2)).collect()]
    assert got == [[11, 12], [10], [13, 14], [10, 11], [12, 13]]


def test_shifted_batches(encoded):
    examples = vocab.training_examples(encoded, seq_len=4)
    got = {r["row_id"]: r for r in vocab.shifted_batches(examples, 2, pad_id=0).collect()}
    assert got[0]["input_ids"] == [10, 11, 12] and got[0]["labels"] == [11, 12, -100]
    assert got[1]["input_ids"] == [10, 0, 0] and got[1]["labels"] == [-100, -100, -100]
    assert got[2]["input_ids"] == [10, 11, 12, 13] and got[2]["labels"] == [11, 12, 13, -100]
    assert got[4]["batch_id"] == 2 and got[4]["input_ids"] == [10, 11, 12, 13]


def test_causal_batches(encoded):
    rows = encoded.withColumnRenamed("subject_id", "row_id").selectExpr("*", "row_id AS subject_id")
    left = {r["row_id"]: r for r in vocab.causal_batches(rows, 3, pad_id=10).collect()}
    assert left[1]["input_ids"] == [10] * 5 and left[1]["labels"] == [-100] * 5
    assert left[0]["attention_mask"] == [0, 0, 1, 1, 1]
    assert left[0]["labels"] == [-100, -100, -100, 11, 12]
    right = {r["row_id"]: r for r in vocab.causal_batches(rows, 3, 0, "right").collect()}
    assert right[0]["input_ids"] == [10, 11, 12, 0, 0]
    assert right[0]["labels"] == [10, 11, 12, -100, -100]
    with pytest.raises(ValueError):
        vocab.causal_batches(rows, 3, 0, "middle")


def test_shuffled_examples_keep_all_rows(encoded):
    got = vocab.training_examples(encoded, 9, shuffle_seed=1).collect()
    assert sorted(r["row_id"] for r in got) == list(range(5))
    assert sorted(len(r["input_ids"]) for r in got) == [1, 2, 3, 4, 5]
