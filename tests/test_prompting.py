"""Prompt rendering, pairs, generation and reply cleaning."""

import pytest
from pyspark.sql import functions as F

from lettermill.functions.templates import chat_markers, fill
from lettermill.operators import generation, prompting as P

TEMPLATES = dict(
    system_preamble="<SYSTEM PREAMBLE>",
    user_preamble="<USER PREAMBLE>",
    rag_preamble="RAG PREAMBLE:\n\n{rag_context}",
    thread_preamble="THREAD PREAMBLE:\n\n{threading_context}",
)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def array(*items):
    return F.array(*map(F.lit, items)).cast("array<string>")


def test_full_prompt(spark):
    prompt = P.email_prompt(
        F.lit("Write."), hits=array("a", "b"), thread=array("t1", "t2", "t3"), thread_emails=2,
        **TEMPLATES,
    )
    assert value(spark, prompt) == (
        "<SYSTEM PREAMBLE>\n\n<USER PREAMBLE>\n\n"
        "RAG PREAMBLE:\n\nE-MAIL CONTENT:\na\n\n---\n\nE-MAIL CONTENT:\nb\n\n---\n\n"
        "THREAD PREAMBLE:\n\nt1\n\n---\n\nt2\n\n---\n\nInstruction: Write."
    )


def test_empty_hits_keep_the_frame_unless_legacy(spark):
    now = P.email_prompt(F.lit("x"), "", hits=array(), rag_preamble="R {rag_context}")
    old = P.legacy_email_prompt(
        F.lit("x"), system_preamble="", hits=array(), rag_preamble="R {rag_context}"
    )
    assert value(spark, now) == "R\n\nInstruction: x"
    assert value(spark, old) == "Instruction: x"


def test_empty_sections_vanish(spark):
    assert value(spark, P.email_prompt(F.lit("x"), " ", "\n")) == "Instruction: x"


def test_missing_templates_raise():
    with pytest.raises(ValueError):
        P.email_prompt(F.lit("x"), hits=array("a"), rag_preamble="")
    with pytest.raises(ValueError):
        P.email_prompt(F.lit("x"), thread=array("a"), thread_emails=1, thread_preamble="")


def test_fill_is_literal_and_simultaneous(spark):
    filled = fill("{a}-{b}-{a}", a=F.lit("{b}$1\\"), b=F.lit("B"))
    assert value(spark, filled) == "{b}$1\\-B-{b}$1\\"
    assert value(spark, fill("none", a=F.lit("x"))) == "none"


@pytest.mark.parametrize(
    "name, start", [("Meta-LLAMA-3", "<|begin"), ("mistralai/x", "[INST] "), ("Phi-3", "<s><|user|> ")]
)
def test_markers(spark, name, start):
    assert value(spark, chat_markers(name)["prompt_start"]).startswith(start)


def test_unknown_model_raises(spark):
    with pytest.raises(Exception):
        value(spark, chat_markers("gpt")["prompt_end"])
    with pytest.raises(ValueError):
        P.generated_text(F.lit("x"), "gpt")


def test_pair_sides(spark):
    # The reply also occurs in the prompt: the split is not searched for.
    assert value(spark, P.pair_prompt(F.lit("say hi"), "mistral")) == "[INST] say hi [/INST]<s>"
    assert value(spark, P.pair_response(F.lit(" hi\n"), "mistral")) == "hi</s>"
    assert value(spark, P.within_length(F.lit("a b"), F.lit("c"), 3)) is True
    assert value(spark, P.within_length(F.lit("a b"), F.lit("c d"), 3)) is False


def test_instruction_checks(spark):
    assert value(spark, P.instruction_of(F.lit("a\n\nInstruction: b\n\nInstruction: c"))) == "c"
    assert value(spark, P.instruction_of(F.lit("plain"))) == "plain"
    for reply, ok in (("no", False), ("Instruction: a", True), ("Instruction: Instruction: ", False)):
        assert value(spark, P.has_one_instruction(F.lit(reply))) is ok
    assert value(spark, P.instruction_behind_key(F.lit("x Instruction: do"))) == "do"


def test_boilerplate(spark):
    reply = "Here is the email:\nSUBJECT: a\nSubject: b\nhello Subject: c\nE-MAIL CONTENT: d\nend"
    assert value(spark, P.strip_boilerplate(F.lit(reply))) == "hello end"


def test_generated_text(spark):
    full = "<s><|user|> q<|end|><|assistant|> r <|end|> junk"
    assert value(spark, P.generated_text(F.lit(full), "phi")) == "r"


def test_summary_prompt_is_stripped(spark):
    got = value(spark, P.summary_prompt(F.lit("body {x}"), "Text:\n{email} \n"))
    assert got == "Text:\nbody {x}"


def test_messages(spark):
    rows = value(spark, P.conversation(F.lit("p"), F.lit("r")))
    assert [(m.role, m.content) for m in rows] == [("user", "p"), ("assistant", "r")]
    assert value(spark, P.user_message(F.lit("p")))[0].content == "p"


def test_echo_generation_keeps_keys_and_counts(spark):
    df = spark.createDataFrame([(i, f"Instruction: {i}") for i in range(3)], "k int, p string")
    rows = generation.generate(df, "p", generation.echo, samples=2).collect()
    assert len(rows) == 6
    assert all(r.response == f"Received: Instruction: {r.k}" for r in rows)


def test_extractive_generation(spark):
    df = spark.createDataFrame([("intro\n\nFirst one. Second.",)], "p string")
    (row,) = generation.generate(df, "p", generation.GENERATORS["extractive"]).collect()
    assert row.response == "Instruction: Write an email saying: First one."


def test_model_is_made_once_per_task(spark):
    def factory():
        calls = []

        def run(prompts):
            calls.append(1)
            import pandas as pd

            return pd.Series([str(len(calls))] * len(prompts))

        return run

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    df = spark.range(0, 6, 1, 1).selectExpr("cast(id as string) p")
    rows = generation.generate(df, "p", factory).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted({r.response for r in rows}) == ["1", "2", "3"]
