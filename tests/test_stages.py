"""The stages composed: mailbox files to training pairs."""

from dataclasses import replace

from pyspark.sql import functions as F

from lettermill.operators import cleaning, generation
from lettermill.operators.embedding import build_index, hashed_terms
from lettermill.operators.prompting import instruction_of
from lettermill.operators.retrieval import RETRIEVERS
from lettermill.plans import stages
from lettermill.plans.evaluation import evaluate
from lettermill.session import cut_lineage, new_work_path
from lettermill.sources import mbox, store


def test_mailbox_to_pairs(spark):
    bodies = [
        f"Dear team number {i}. The plan for week {i} is ready and I will send it to everybody soon."
        for i in range(10)
    ]
    raw = spark.createDataFrame(
        [
            (f"From: me@x\nSubject: s{i}\nDate: Mon, {i + 1:02d} Jan 2024 10:00:00 +0000\n\n{b}\n",)
            for i, b in enumerate(bodies)
        ],
        "raw string",
    )
    path = new_work_path(spark, "mbox")
    mbox.write_mbox(raw, path, F.lit("me@x"))
    settings = stages.Settings(
        addresses=("me@x",), test_split=0.2, split_type="chronological", neighbours=3, rag_emails=2,
        relevance_threshold=-9.0, chunk_size=200, chunk_overlap=200, chat_model="mistral",
        system_preamble="",
    )
    flagged = stages.extract(spark, path, settings)
    emails = cut_lineage(cleaning.clean_emails(flagged))
    assert sorted(r.email for r in emails.collect()) == sorted(bodies)

    instructed, rejected = stages.instruct(emails, generation.extractive)
    assert rejected.count() == 0
    ready = cut_lineage(stages.split(instructed, settings))
    train = ready.where("split = 'train'")
    assert {r.subject for r in train.collect()} == {f"s{i}" for i in range(8)}

    model = hashed_terms(64)
    chunks = cut_lineage(stages.index(train, settings, model))
    found = cut_lineage(stages.enrich(train, chunks, settings, model))
    for r in found.collect():
        got = [h.serialized_email.email for h in r.relevant_emails]
        assert 2 <= len(got) <= 3 and r.email not in got
    pairs = stages.training_pairs(found, settings).collect()
    assert len(pairs) == 8 and all(p.fits for p in pairs)
    for p in pairs:
        assert p.prompt.startswith("[INST] Extract specific") and p.prompt.endswith(" [/INST]<s>")
        assert p.prompt.count("E-MAIL CONTENT:") == 2
        assert p.response.endswith("soon.</s>")

    as_asked = stages.enrich(
        train, chunks, settings, model,
        query_text=instruction_of(F.col("summary")), drop_contained=False, exclude_self=False,
    )
    assert all(len(r.relevant_emails) == 3 for r in as_asked.collect())


def test_invalid_instructions_are_set_aside(spark):
    def factory():
        return lambda prompts: prompts.map(
            lambda p: "no key" if "bad" in p else "Instruction: do it"
        )

    emails = spark.createDataFrame([("a", "good"), ("b", "bad")], "email_id string, email string")
    kept, rejected = stages.instruct(emails, factory)
    assert [(r.email, r.summary) for r in kept.collect()] == [("good", "do it")]
    assert [(r.email, r.reply) for r in rejected.collect()] == [("bad", "no key")]
    everything, _ = stages.instruct(emails, factory, validate=False)
    assert everything.count() == 2


def test_run_parameters(spark):
    """Own templates, another prompt builder, no retrieval, replies without metrics."""
    rows = [("a", "first mail", ["t1"], 10**15, "Instruction: ask"), ("b", "second mail", ["t2"], 3 * 10**15, "Instruction: ask")]
    test = spark.createDataFrame(rows, "email_id string, email string, thread array<string>, seq bigint, summary string")
    made = evaluate(
        test, generation.echo, use_thread=True, thread_emails=1, system_preamble="S",
        thread_preamble="THREAD {threading_context}", compute_metrics=False,
    )
    assert made.scores is None and made.metrics is None
    reply = made.responses.first()["response"]
    assert "S\n\nTHREAD t2" in reply and made.responses.count() == 1
    assert sorted((r.golden_no, r.golden) for r in made.goldens.collect()) == [(0, "first mail"), (1, "second mail")]
    shouted = evaluate(test, generation.echo, build_prompt=lambda text, *_, **__: F.upper(text), compute_metrics=False)
    assert "INSTRUCTION: ASK" in shouted.responses.first()["response"]

    settings = stages.Settings(addresses=("a",), neighbours=1, rag_emails=1, rag_preamble="HITS {rag_context}", system_preamble="")
    train = test.withColumn("subject", F.lit("s")).withColumn("date_iso", F.lit("2024-01-01T00:00:00"))
    chunks = cut_lineage(stages.index(train, settings, hashed_terms(8)))
    found = stages.enrich(train, chunks, settings, hashed_terms(8), retriever=RETRIEVERS["none"])
    pairs = stages.training_pairs(found, settings).collect()
    assert len(pairs) == 2 and all("HITS" in p.prompt for p in pairs)
    near = stages.enrich(train, chunks, replace(settings, probes=1, cells=1), hashed_terms(8), exclude_self=False, drop_contained=False)
    assert all(len(r.relevant_emails) == 1 for r in near.collect())


def test_cleaning_is_evaluated_once(spark):
    parts = spark.createDataFrame([], "msg_id string, part_no int, from_addr string, subject string, date_raw string, date_iso string, date_us bigint, content_type string, payload binary")
    plan = cleaning.clean_emails(cleaning.flag_parts(parts, ["me@x"]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct") == 1
    assert cleaning.flag_parts(parts, []).count() == 0


def test_batch_and_stream_share_an_index(spark):
    out = new_work_path(spark, "store")
    emails = spark.createDataFrame([("e1", "some text", "s", ["t"], "2024-01-01", None)],
        "id string, email string, subject string, thread array<string>, date string, summary string")
    chunks = build_index(emails, "id", "my index", hashed_terms(8), 100, 10, recursive=False)
    store.store_chunks(chunks, out)
    chunks.drop("index_name").write.parquet(f"{store.index_folder(spark, out, 'my index')}/batch_id=stream-0")
    store.store_chunks(chunks.withColumn("index_name", F.lit("other")), out)
    assert store.load_index(spark, out, "my index").count() == 2
    store.replace_index(chunks, out)
    assert store.load_index(spark, out, "my index").count() == 1
    assert store.load_index(spark, out, "other").count() == 1


def test_goldens_are_numbered_once(spark):
    """All metrics read the numbered goldens from a table: their window is not run again."""
    test = spark.createDataFrame(
        [("p", 1, "one two", ["t"]), ("p", 2, "two three", ["t"]), ("q", 3, "four", ["t"])],
        "summary string, seq long, email string, thread array<string>",
    )
    found = evaluate(test, generation.echo, cells=2)
    assert "Window" not in found.goldens._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.golden_no, r.golden) for r in found.goldens.collect()) == [(0, "four"), (0, "one two"), (1, "two three")]
