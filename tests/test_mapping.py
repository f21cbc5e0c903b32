import csv
import json
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from termweave.plans.build import build_index
from termweave.plans.mapping import Options, candidate_column, look_up, map_terms, relevance, run_bulk
from termweave.sources import clients, files, usagi
from termweave.sources.encoders import HashedNgrams, LateInteraction, Transformer, pooled, resolved_device, resolved_model


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("vocabulary"))
    names = ["acetaminophen 500 mg oral tablet", "acetaminophen 5 mg oral tablet", "albuterol 90 mcg/actuation inhaler", "ibuprofen 200 mg oral tablet"]
    rows = [(i, n, f"C{i}", "Drug", "Clinical Drug", "RxNorm", "S", None) for i, n in enumerate(names, 1)]
    spark.createDataFrame(rows, "concept_id long, concept_name string, concept_code string, domain_id string, concept_class_id string, vocabulary_id string, standard_concept string, invalid_reason string").write.parquet(f"{folder}/concept.parquet")
    out = str(tmp_path_factory.mktemp("index"))
    build_index(spark, folder, out, "drugs", domains="Drug", extra=["concept_name", "domain_id"], with_code=False)
    return out


def test_manifest(spark, index):
    m = files.read_manifest(spark, index, "drugs")
    assert m["count"] == 4 and m["vector_dim"] == 256 and m["domain_id"] == ["Drug"]
    assert files.read_manifest(spark, index, "absent") is None
    assert files.encoder_settings(m, pooling="mean")["pooling"] == "mean"
    with pytest.raises(ValueError):
        files.read_sheet(spark, "a.doc")


def test_look_up(spark, index):
    df, vector = files.read_index(spark, index, "drugs")
    best = look_up(spark, "Paracetamol 500mg tablet", df, vector, HashedNgrams())
    assert best[0]["concept_id"] == 1
    notes = map_terms(spark, spark.createDataFrame([("x",)], "sourceName string"), df, vector, Options(where="absent = 1"), HashedNgrams()).notes
    assert notes
    some = look_up(spark, "Paracetamol 500mg tablet", df, vector, HashedNgrams(), Options(where="concept_id > 1"))
    assert 1 not in [r["concept_id"] for r in some]


def test_bulk(spark, index, tmp_path):
    sheet = tmp_path / "terms.csv"
    sheet.write_text('sourceCode,sourceName,mappingStatus,matchScore,conceptId\nA,"Paracetamol 500mg tablet",APPROVED,0.5,1\nB,ibuprofen 200 mg,UNCHECKED,,\n')
    got = run_bulk(spark, index, "drugs", str(sheet), str(tmp_path / "out"), Options(candidate_topk=3), topk=2)
    wide = list(csv.reader(open(got["results"])))
    assert wide[0][0] == "rank" and wide[0][3] == "A" and wide[0][1] == "1" and wide[1][1] == "X"
    beside = list(csv.DictReader(open(got["with_input"])))
    assert [r["sourceCode"] for r in beside] == ["A", "B"] and beside[1]["top1_concept_id"] == "4"
    review = list(csv.DictReader(open(got["usagi"])))
    assert review[0]["mappingStatus"] == "UNCHECKED" and review[0]["conceptId"] == "1"
    assert json.load(open(got["metrics"]))["hit@1"] == 1.0


class Stub:
    """In place of a model: two-dimensional vectors of words, padded."""

    def hidden(self, texts):
        n = max((len(t.split()) for t in texts), default=0)
        out, mask = np.zeros((len(texts), n, 2), np.float32), np.zeros((len(texts), n), bool)
        for i, t in enumerate(texts):
            for j, w in enumerate(t.split()):
                out[i, j], mask[i, j] = (len(w), w.count("a")), True
        return out, mask


class StubEncoder(Stub, Transformer):
    pass


class StubReranker(Stub, LateInteraction):
    pass


def test_pooling_with_a_stub():
    hidden, mask = Stub().hidden(["aa b", "ccc"])
    assert pooled(hidden, mask, "cls").tolist() == [[2, 2], [3, 0]]
    assert pooled(hidden, mask, "mean").tolist() == [[1.5, 1.0], [3, 0]]
    with pytest.raises(ValueError):
        pooled(hidden, mask, "max")
    for how in ("cls", "mean"):
        enc = StubEncoder("stub", pooling=how)
        assert enc([]).shape == (0, 2)
        assert np.allclose(np.linalg.norm(enc(["aa b", "ccc"]), axis=1), 1.0) and enc(["aa b"]).dtype == np.float32
    # a text has its own tokens only, whatever it was padded with
    assert [len(v) for v in StubReranker("stub")(["aa b", "ccc", ""])] == [2, 1, 0]


def test_reranking_with_a_stub(spark):
    # workers do not import this module
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    pairs = spark.createDataFrame([("aa b", "aa b"), ("aa b", "ccc"), ("aa", None)], "query_norm string, profile_text_norm string")
    got = [r["_relevance_score"] for r in relevance(pairs, StubReranker("stub")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] < 1.0 and got[2] == pytest.approx(-0.5)
    with pytest.raises(ValueError):
        candidate_column(["concept_name"])
    assert candidate_column(["profile_text_norm", "profile_text"]) == "profile_text"


def test_devices_and_models(tmp_path):
    assert resolved_device("mps") == "mps" and resolved_device("auto") in ("cpu", "cuda", "mps")
    assert resolved_model(str(tmp_path)) == str(tmp_path) and resolved_model("some/model") == "some/model"


def test_text_files(spark, tmp_path):
    path = f"file://{tmp_path}/a/b.txt"
    for k, append in (("x", False), ("é\n", True), ("z" * 3_000_000, True), ("y", False)):
        with files.TextFile(spark, path, append) as f:
            f.write(k)
        if k == "z" * 3_000_000:
            assert files.file_text(spark, path) == "xé\n" + k
    assert files.file_text(spark, path) == "y"


def test_duckdb_files(spark, tmp_path):
    import duckdb

    path = str(tmp_path / "v.duckdb")
    with duckdb.connect(path) as con:
        con.execute("CREATE TABLE concept AS SELECT i AS concept_id, 'drug ' || i AS concept_name, 'C' AS concept_code, 'Drug' AS domain_id, 'x' AS concept_class_id, 'V' AS vocabulary_id, 'S' AS standard_concept, CAST(NULL AS VARCHAR) AS invalid_reason FROM range(5) t(i)")
    folder = files.duckdb_tables(spark, path, ["concept", "absent"])
    assert files.table_or_none(spark, folder, "absent") is None and files.table_or_none(spark, folder, "concept").count() == 5
    out = str(tmp_path / "index")
    build_index(spark, folder, out, "drugs", domains="Drug")
    assert files.read_manifest(spark, out, "drugs")["count"] == 5
    with pytest.raises(FileNotFoundError):
        files.duckdb_tables(spark, str(tmp_path / "none.duckdb"), ["concept"])


def test_long_texts_are_encoded_whole():
    a, b = HashedNgrams()(["x " * 600 + "one", "x " * 600 + "other"])
    assert not np.allclose(a, b)


def test_importable_names():
    import importlib

    for name in ("functions", "operators", "sources", "plans"):
        m = importlib.import_module(f"termweave.{name}")
        assert all(hasattr(m, n) for n in m.__all__)


def test_review_sheets(spark):
    df = spark.createDataFrame([("", "a", "x", "U"), ("c", "b", "1.5", "U")], "sourceCode string, sourceName string, matchScore string, mappingStatus string")
    assert usagi.is_review_sheet(df.columns) and usagi.invalid_rows(df).count() == 1
    own = usagi.review_rows(spark.createDataFrame([(0, None)], "query_id long, drug_id string"), code_col="drug_id").first()
    assert own["sourceName"] == "Query 1" and own["sourceCode"] == "ROW_00001" and own["mappingType"] == "MAPS_TO"


def test_clients():
    assert clients.found_text({"result": {"output": [{"content": [{"type": "output_text", "text": "Rank: 1"}]}]}}) == "Rank: 1"
    assert clients.found_text({"result": {"response": "A, B.", "usage": {"prompt_tokens": 1}}}) == "A, B."
    url, payload = clients.client("openrouter", api_key="k").request("p")
    assert url.endswith("/chat/completions") and payload["response_format"]["type"] == "json_schema" and "top_p" not in payload
    url, _ = clients.Cloudflare(model="meta/llama", account_id="a").request("p")
    assert url.endswith("/ai/run/@cf/meta/llama")
    assert clients.cut("a STOP b", ["STOP"]) == "a"
    with pytest.raises(ValueError):
        clients.client("absent")


def test_numbering(spark):
    df = spark.range(100).repartition(3)
    assert sorted(r["query_id"] for r in files.numbered(df).collect()) == list(range(100))
    assert files.numbered(df, first_rows=7).count() == 7


def test_stream(spark, index, tmp_path):
    from termweave.streaming.live import map_stream

    (tmp_path / "in").mkdir()
    spark.createDataFrame([("ibuprofen 200 mg",)], "sourceName string").write.parquet(str(tmp_path / "in/a"))
    df, vector = files.read_index(spark, index, "drugs")
    terms = spark.readStream.schema("sourceName string").parquet(str(tmp_path / "in/*"))
    map_stream(terms, df, vector, HashedNgrams(), str(tmp_path / "out"), str(tmp_path / "checkpoint"), Options(candidate_topk=2)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("rank = 1").first()["concept_id"] == 4


def test_command_line():
    from termweave.__main__ import parser

    a = parser().parse_args(["infer", "bulk", "--db", "d", "--table", "t", "--input", "i", "--out", "o"])
    assert (a.candidate_topk, a.retrieval_topk, a.post_mode, a.tiebreak_topn) == (100, 400, "tiebreak", 50)
    more = ["--device", "auto", "--reranker-id", "m", "--convert-inn-to-usan", "--ollama-model", "o", "--ollama-base-url", "http://o"]
    a = parser().parse_args(["infer", "bulk", "--db", "d", "--table", "t", "--input", "i", "--out", "o", *more])
    assert (a.device, a.reranker_id, a.inn2usan, a.rag_model, a.rag_base_url) == ("auto", "m", True, "o", "http://o")


def test_clients_from_flags(tmp_path):
    from termweave.__main__ import model_client, parser, prompt_builder

    base = ["infer", "bulk", "--db", "d", "--table", "t", "--input", "i", "--out", "o"]
    read = lambda *x: parser().parse_args([*base, *x])
    assert model_client(read()) is None
    assert isinstance(model_client(read("--rag-provider", "llamacpp")), clients.LlamaServer)
    assert isinstance(model_client(read("--rag-provider", "llamacpp", "--llamacpp-model-path", "m")), clients.LlamaLocal)
    assert model_client(read("--rag-provider", "cloudflare", "--gpt-reasoning-effort", "low")).reasoning == {"effort": "low"}
    with pytest.raises(ValueError):
        model_client(read("--rag-provider", "ollama", "--rag-candidate-limit", "0"))
    (tmp_path / "t.md").write_text("{source}: {candidates} {format_instructions}{extra_context}")
    build = prompt_builder(read("--rag-template", str(tmp_path / "t.md"), "--rag-profile-char-limit", "3"))
    assert build("q", [{"concept_id": 1, "profile_text": "abcdef"}], context="c").startswith("q: abc … (1)")


def test_command_line_look_up(spark, index, capsys):
    from termweave.__main__ import main

    ask = ["infer", "query", "--db", index, "--table", "drugs", "--query", "ibuprofen 200 mg oral tablet", "--show-topk", "2", "--debug"]
    assert main([*ask, "--expect-name", "ibuprofen 200 mg oral tablet"]) == 0
    assert "strength_sim" in capsys.readouterr().out
    assert main([*ask, "--expect-name", "another"]) == 1


def test_rows_of_the_same_text_are_mapped_once(spark, monkeypatch):
    """60 rows of two texts and of none: three searches, and every row has its candidates."""
    from termweave.plans import mapping
    from termweave.queries import Letters, LetterTokens
    from termweave.sources.encoders import encoded

    asked, real = [], mapping.retrieve
    monkeypatch.setattr(mapping, "retrieve", lambda queries, *a: asked.append(queries.count()) or real(queries, *a))
    names = ["aspirin 5 mg", "aspirin 10 mg [brand]", "codeine 5 mg", "ibuprofen"]
    index = encoded(spark.createDataFrame([(i, n, n) for i, n in enumerate(names)], "concept_id long, concept_name string, profile_text string"), "profile_text", Letters())
    sheet = spark.createDataFrame([(n,) for _ in range(20) for n in ("aspirin  5 mg", "Codeine 5 mg", None)], "sourceName string").repartition(5)
    o = mapping.Options(candidate_topk=2, retrieval_topk=3, code_column=None)
    got = mapping.map_terms(spark, sheet, index, "vector", o, Letters(), LetterTokens())
    assert asked == [3] and got.errors.count() == 20
    by = {}
    for r in got.candidates.join(got.queries.select("query_id", "query_norm"), "query_id").collect():
        by.setdefault((r["query_norm"], r["query_id"]), set()).add((r["rank"], r["concept_id"], r["final_score"]))
    assert len(by) == 40 and len({(n, frozenset(c)) for (n, _), c in by.items()}) == 2
    assert {c for (n, _), own in by.items() for k, c, _ in own if k == 1 and n.startswith("aspirin")} == {0}
    # without a reranker empty texts are searched as well, as before
    plain = mapping.map_terms(spark, sheet, index, "vector", o, Letters())
    assert plain.candidates.groupBy("query_id").count().filter("count = 2").count() == 60
