"""Token counts and SentencePiece coding against the library, and defined cases."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from trustweave.llm import sentencepiece_codec, token_count
from trustweave.llm.units import check_units, load_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = "ab  \n\t\r▁<s>é漢🙂'\u0000　}the of"


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 25))) for _ in range(n)] + ["", " ", "\n", "<s> </s>", "x" * 5000, "a b " * 3000]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_counts_equal_the_library(library):
    counter = token_count.UnitCounter(PATH, {})
    for x in texts(3000, 1):
        assert counter.count(x) == len(library.encode(x)), repr(x)


def test_counts_as_a_query(spark, library):
    rows = [(1, "a b", 7), (1, "a b", 7), (None, "漢 x", 8), (2, None, 9), (3, "", 1), (4, "word " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = token_count.count_tokens(df, PATH, limit=4096).collect()
    assert sorted(out[0].asDict()) == ["doc_id", "n_bytes", "n_tokens", "over_limit", "text"]
    for r in out:
        assert r.n_bytes == len((r.text or "").encode()) and r.n_tokens == len(library.encode(r.text or ""))
        assert r.over_limit == (r.n_tokens > 4096)
    assert len(out) == len(rows)
    assert token_count.count_tokens(df.limit(0), PATH).count() == 0


def test_best_path_equals_brute_force_and_library():
    codec = sentencepiece_codec.Codec(PATH)
    model = load_model(PATH)
    score = {p.piece: p.score for p in model.pieces if p.type == 1}
    low = min(score.values()) - 10

    def brute(s):
        best = [0.0] + [-np.inf] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - 16), e):
                best[e] = max(best[e], best[b] + score.get(s[b:e], low if e - b == 1 else -np.inf))
        return best[-1]

    for x in ["▁the", "▁thethe", "▁漢字é", "abc▁", "xq🙂z"]:
        ids = codec.best_path(x)
        total, at = 0.0, 0
        pieces = [model.pieces[i] for i in ids]
        while at < len(pieces):
            if pieces[at].type == 6:
                first = int(pieces[at].piece[3:5], 16)
                at += 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                total += low
            else:
                total += pieces[at].score
                at += 1
        assert total == brute(x)
    unigram = sentencepiece_model_pb2.ModelProto()
    unigram.CopyFrom(model)
    unigram.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram.SerializeToString())
    for x in ["The quick brown fox", "", "a  b\nc", "über 漢字"]:
        assert np.frombuffer(codec.encode(x), np.int32).tolist() == library.encode(x)


def test_round_trip_and_defined_cases(spark):
    some = [x for x in texts(500, 2)]
    rows = [(i, x, [1]) for i, x in enumerate(some)] + [(None, None, [2]), (0, some[0], [1])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    coded = sentencepiece_codec.encode_texts(df, PATH, verify=True)
    out = coded.collect()
    assert len(out) == len(rows) and all(r.round_trip for r in out)
    assert all((r.ids is None) == (r.text is None) and r.n_tokens == len(r.ids or []) for r in out)
    back = sentencepiece_codec.decode_ids(coded.withColumnRenamed("text", "source"), PATH).collect()
    assert all(r.text == (None if r.source is None else r.source.replace("▁", " ")) for r in back)
    assert sentencepiece_codec.encode_texts(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        sentencepiece_codec.Codec(PATH).decode(np.array([40_000]))


def test_models_whose_pieces_cross_units_are_refused():
    model = load_model(PATH)
    check_units(model)
    model.pieces.add(piece="a▁b", score=-1.0, type=1)
    with pytest.raises(ValueError):
        check_units(model)


def test_ids_equal_the_untouched_library(spark, library):
    codec = sentencepiece_codec.worker_codec(PATH)
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(60).collect()]
    rng = random.Random(4)
    runs = ["".join(rng.choice(["▁", " ", "a", "aa", "th", "ing", "==", "--", "é", "漢", "🙂", "0", "\n"]) * rng.randrange(1, 6) for _ in range(12)) for _ in range(1500)]
    for x in [*given, *texts(3000, 5), *runs, *[" " * k + "x" * (k % 3) for k in range(70)], "a" * 999, "=" * 999, " " * 999]:
        assert np.frombuffer(codec.encode(x), np.int32).tolist() == library.encode(x), repr(x)
    df = spark.createDataFrame([(k, x) for k, x in enumerate(given)], "doc_id long, text string")
    coded = {r.doc_id: r for r in sentencepiece_codec.encode_texts(df, PATH, verify=True).collect()}
    counted = {r.doc_id: r.n_tokens for r in token_count.count_tokens(df, PATH, limit=4096).collect()}
    assert all(r.ids == library.encode(r.text) and r.round_trip and r.n_tokens == counted[r.doc_id] for r in coded.values())


def test_model_types_choose_the_encoding(tmp_path):
    model = load_model(PATH)
    for kind, made in ((1, sentencepiece_codec.Codec), (2, sentencepiece_codec.MergeCodec)):
        model.trainer_spec.model_type = kind
        (tmp_path / f"{kind}.model").write_bytes(model.SerializeToString())
        assert type(sentencepiece_codec.worker_codec(str(tmp_path / f"{kind}.model"))) is made
    model.trainer_spec.model_type = 3
    (tmp_path / "3.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        sentencepiece_codec.worker_codec(str(tmp_path / "3.model"))
