"""The queries of the subpackage against their SQL, and the pipeline stage by stage."""

import duckdb

import __spark_entry__ as entry
import corpus_pipeline
from partlens.llm import byte_bpe, decontaminate, minhash_dedup, quality, secret_scan

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    names = {name.split("_")[0] for name in entry.queries() if name.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()


def test_contamination_matches_sql(spark):
    duck = duckdb.connect()
    for table in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    expected = duck.execute(entry.oracle_sql()["op5_decontaminate"])
    columns = [c[0] for c in expected.description]
    got = entry.queries()["op5_decontaminate"](spark, FOLDER).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(expected.fetchall())


def test_stages_do_what_their_operators_say(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    kept = corpus_pipeline.keep_quality(spark, docs, FOLDER)
    assert ids(kept) == ids(quality.classify(docs, labels).where("kept")) and kept.columns == docs.columns
    kept = spark.createDataFrame(kept.collect(), docs.schema)
    single = corpus_pipeline.drop_near_copies(spark, kept, FOLDER)
    assert ids(single) == ids(minhash_dedup.near_duplicates(kept, 5, 80).where("kept")) and single.columns == docs.columns
    single = spark.createDataFrame(single.collect(), docs.schema)
    clean = corpus_pipeline.drop_contaminated(spark, single, FOLDER)
    assert ids(clean) == ids(single) - ids(decontaminate.contaminated(single, items)) and clean.columns == docs.columns
    clean = spark.createDataFrame(clean.collect(), docs.schema)
    masked = corpus_pipeline.mask_secrets(spark, clean, FOLDER)
    assert ids(masked) == ids(clean) and masked.columns == docs.columns
    hidden = masked.where("text LIKE '%[SECRET]%'")
    assert ids(hidden) == ids(secret_scan.find_secrets(clean).where("size(secrets) > 0"))
    last = corpus_pipeline.tokenize(spark, masked, FOLDER).collect()
    assert len(last) == len(ids(masked)) and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in last)
    assert {r["doc_id"] for r in entry.queries()["pipeline"](spark, FOLDER).select("doc_id").collect()} == ids(masked)


def test_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
        assert docs.count() == 0
    assert byte_bpe is not None and corpus_pipeline.tokenize(spark, docs, FOLDER).count() == 0


def test_no_task_of_the_last_stage_has_two_python_workers(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    plan = corpus_pipeline.tokenize(spark, docs, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_task_reads_the_tokenizer_once(spark, monkeypatch):
    import pyarrow as pa
    import public_tokenizers
    import tokenizers

    made = []

    class Counted:
        @staticmethod
        def from_str(text, own=tokenizers.Tokenizer.from_str):
            made.append(len(text))
            return own(text)

    def in_process(df, fields, inputs, fn):
        return fn()(pa.array([" ab, ab c", None, ""]))[0].to_pylist()

    monkeypatch.setattr(byte_bpe, "add_columns", in_process)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.range(1).selectExpr("'' AS text")
    model_json = byte_bpe.tokenizer_json(byte_bpe.read_ranks(ranks))
    monkeypatch.setattr(byte_bpe, "tokenizer_json", lambda _: model_json)
    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    found = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, with_offsets=False)
    assert len(found[0]) > 0 and found[1:] == [[], []] and len(made) == 1
