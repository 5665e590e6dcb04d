"""Documents with planted tells: each document gets one of 32 snippets, chosen by its id, in Spark and SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.sources.readers import spread, table

_PARAGRAPH = "We met at noon and spoke about the plan for the week.\n\n"
#: (before the document's text?, snippet)
SNIPPETS = [
    (False, " We delve into a rich tapestry of robust and seamless ideas, and then delve again."),
    (False, " It's important to\nnote that in conclusion the world of work is more than just a job."),
    (False, " Let's dive into it. It stands as a testament to them, and serves as a bridge. It serves as a door."),
    (False, " This cannot be overstated, from the moment it began. It serves as a bridge."),
    (False, " They want not just speed but calm. Not just one but two."),
    (False, " It is not a bug, it is a feature. It isn't a cat, it's a dog."),
    (False, "\nEver wondered how it works\nWhat if it fails\nimagine a world"),
    (False, " It may work, might fail, can stop and could often typically generally go wrong."),
    (False, " He won, highlighting the need for care. She left, reflecting a trend. It fell, cementing the end."),
    (False, " It isn't small. It's big. They aren't late! It is early. It wasn't red. It's blue."),
    (False, " A place where people meet, where people talk, and where people stay. A time when rain fell, when wind blew, when snow came."),
    (False, "\nHere's why it works\n# Here's how to do it\nhere’s what we know"),
    (False, "\nThe result? It works. Well. The catch? It costs.\nThe bottom line? Go."),
    (True, "Certainly! Here you are.\nGreat question! It is so.\n"),
    (False, " Despite the many challenges and setbacks of last year it continues to grow."),
    (False, " See turn0 oaicite oai_citation and utm_source=chatgpt.com/share. Later claude.ai/share too."),
    (True, "As an AI I cannot browse the internet. As of my last update it was so.\n"),
    (False, " One — two — three — four — five — six — seven — eight — nine — ten — eleven — twelve — more — ends."),
    (False, " Good ✅ and ❤️ and 🚀🎉 and 🇫🇷 done ✓."),
    (False, "\n# Launch 🚀 day ✨\n- item ✅\n1. step 🎉\nplain ✨"),
    (False, "\nThis **is** a **lot** of **bold** in **one** place, **too** much **of** it **all** here **now** and **then** again **so** it **goes** on **and** on."),
    (False, "\n**Speed:** fast\n- **Cost**: low\n2. **Safety.** high\n* **Fun:** yes"),
    (False, "\n• one\n▪ two\n‣ three\n  • four"),
    (False, "\n# Introduction\ntext\n## **Key Takeaways:**\ntext\n#### Deep\ntext\n# Final Thoughts.\n"),
    (False, " ‘one’ ‘two’ it's he's she's “a” “b” \"c\" \"d\"."),
    (False, " a, b, c, d, e, f, g, h, i, j, k, l, m, n, o, p, q, r, s, t, u, v, w, x, y, z, a, b, c, d, e, f, g"),
    (True, _PARAGRAPH * 6),
    (False, " More join? Fewer leave? The end? He came. Why not? It is so."),
    (False, "\nMoreover, it rains. Furthermore, it snows. Additionally it hails. Overall, bad. In essence, wet. Notably cold."),
    (False, " Il est important de noter que cela plonge dans un monde fascinant, sans effort, sans faille. Cela révolutionne, il convient de souligner."),
    (False, " Tauchen Sie ein in die nahtlose, ganzheitliche Welt. Es ist wichtig zu beachten, dass dies bahnbrechend ist."),
    (False, " We walked home and had tea. The kettle was slow. Nobody minded."),
]


def tells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, truth, source, tell_id, text``: all documents, each with its snippet."""
    rows = spark.createDataFrame([(i, b, s) for i, (b, s) in enumerate(SNIPPETS)], "tell_id long, before boolean, body string")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    joined = docs.join(F.broadcast(rows), F.pmod("doc_id", F.lit(len(SNIPPETS))) == F.col("tell_id"))
    body = F.coalesce("text", F.lit(""))
    return joined.select("doc_id", F.col("lang").alias("truth"), "source", "tell_id", F.when(F.col("before"), F.concat("body", body)).otherwise(F.concat(body, "body")).alias("text"))


def sql() -> str:
    """The same relation as a common table expression ``tells(doc_id, truth, source, tell_id, t)``, already normalised."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {str(b).lower()}, {quoted(s)})" for i, (b, s) in enumerate(SNIPPETS))
    norm = "replace(regexp_replace(x, '\\r\\n?|[\\x1c-\\x1f\\x{85}\\x{2028}\\x{2029}]', chr(10), 'g'), chr(65279), ' ')"
    return f"""snippet(tell_id, before, body) AS (VALUES {values}),
tells AS (SELECT doc_id, truth, source, tell_id, {norm} AS t FROM (SELECT d.doc_id, d.lang AS truth, d.source, s.tell_id,
  CASE WHEN s.before THEN s.body || coalesce(d.text, '') ELSE coalesce(d.text, '') || s.body END AS x
  FROM documents d JOIN snippet s ON (d.doc_id % {len(SNIPPETS)} + {len(SNIPPETS)}) % {len(SNIPPETS)} = s.tell_id)),
low AS (SELECT *, replace(lower(t), '’', '''') AS l FROM tells)"""
