import re

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, ids=None, lang="en"):
    """A documents table of these texts, with columns in its schema's order."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return WORD.findall(text or "")
