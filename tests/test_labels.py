import pytest
from pyspark.sql import functions as F

from meterline.functions.labels import model_label, project_label, project_short_name, short_file_label

# fixed values: (model id, expected label) pairs of the reference's label table
MODEL_LABEL_CASES = [
    ("claude-opus-4-1-20250805", "Opus-4.1"),
    ("claude-sonnet-4-5-20250929", "Sonnet-4.5"),
    ("claude-haiku-4-5-20251001", "Haiku-4.5"),
    ("claude-opus-4-20250514", "Opus-4"),
    ("claude-sonnet-4-20250514", "Sonnet-4"),
    ("claude-haiku-3-20240307", "Haiku-3"),
    ("claude-opus-4-6", "Opus-4.6"),
    ("claude-sonnet-4-6", "Sonnet-4.6"),
    ("claude-haiku-4-5", "Haiku-4.5"),
    ("claude-opus-4", "Opus-4"),
    ("gpt-4o", "gpt-4o"),
    ("gpt-4o-mini", "gpt-4o-mini"),
    ("gpt-4", "gpt-4"),
    ("gpt-3.5-turbo", "gpt-3.5"),
    ("some-unknown-model", "some-unknown"),
    ("very-long-model-name-that-exceeds-limit", "very-long-mo"),
]


def _eval(spark, fn, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_model_labels(spark):
    got = _eval(spark, model_label, [m for m, _ in MODEL_LABEL_CASES])
    assert got == [label for _, label in MODEL_LABEL_CASES]


def test_claude_3_names_fall_back_to_prefix(spark):
    # the version-first ids match no pattern and are cut to 12 characters
    assert _eval(spark, model_label, ["claude-3-5-sonnet-20241022"]) == ["claude-3-5-s"]


@pytest.mark.parametrize("path,label", [
    ("", "unknown"),
    ("unknown", "unknown"),
    ("/data/projects/p3", "p3"),
    ("/home/u/.claude/projects/-Users-alice-go_src-myproject", "src-myproject"),
    ("/x/projects/-Users-bob-blog-tech-news", "blog-tech-news"),
    ("/x/projects/-Users-bob-work-claude-agents", "agents"),   # short lower-case words are skipped
    ("/x/projects/-Users-bob-Work-ClaudeAgents", "Work-ClaudeAgents"),
    ("/x/projects/-Users-bob-lib_src-9tool", "src-9tool"),
    ("/x/projects/-Volumes-DATA_01-tools", "tools"),
])
def test_project_labels(spark, path, label):
    assert _eval(spark, project_label, [path]) == [label]


def test_file_and_short_names(spark):
    assert _eval(spark, short_file_label, ["/a/projects/p/s1/subagents/agent-1.jsonl", "/a/projects/p/s1.jsonl"]) \
        == ["subagents/agent-1.jsonl", "s1.jsonl"]
    assert _eval(spark, project_short_name, ["/a/b/proj", ""]) == ["proj", "unknown"]
