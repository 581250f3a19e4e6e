"""Translating books: ordered inside a book, since each chunk needs what came before, and parallel over books."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Translation
from ..functions.text import TOKEN
from ..operators.context import relevant_entities
from ..operators.provider import Provider, Refused, RetryLater, completed
from ..operators.quality import END, json_in
from .prompts import prompt

SUMMARISED = ("chapter", "frontmatter", "backmatter")
SCHEMA = "book_id string, chunk_id string, attempt int, translated_text string, analysis string, verdict string, issues string, selected boolean, summary string, overlap_chunk_id string, error string, passes int, prompt_tokens long, completion_tokens long"


def tokens(text: str) -> int:
    return len(re.findall(TOKEN, text or ""))


def window(summaries: list[tuple[str, str]], budget: int) -> str:
    """The newest summaries within the budget (the newest always), in order."""
    kept, used = [], 0
    for _, s in reversed(summaries):
        used += tokens(s)
        if kept and used > budget:
            break
        kept.append(s)
    return "\n---\n".join(reversed(kept))


def gate(source: str, output: str, t: Translation) -> str:
    n = tokens(source)
    ratio = tokens(output) / n if n else 1.0
    return "short" if ratio < t.shortest else "long" if ratio > t.longest else "ok"


def slots(system: str, content: str, **context: str | None) -> list[dict[str, str]]:
    """A system message, each context that is not empty with its acknowledgement, and the content."""
    out = [{"role": "system", "content": system}]
    for name, text in context.items():
        if text:
            out += [{"role": "user", "content": f"{name.replace('_', ' ').capitalize()}:\n{text}"}, {"role": "assistant", "content": "Understood."}]
    return [*out, {"role": "user", "content": content}]


def draft_messages(source: str, glossary: str, summary: str, before: tuple[str, str] | None) -> list[dict[str, str]]:
    """First pass: translate, with the terms, the story so far and the text before with its translation."""
    overlap = f"{before[0]}\n\nTranslated as:\n{before[1]}" if before else None
    return slots(prompt("draft", end=END), source, glossary=glossary, story_so_far=summary, text_before_not_to_be_translated_again=overlap)


def polish_messages(source: str, draft: str) -> list[dict[str, str]]:
    """Second pass: the source and the draft alone."""
    return slots(prompt("polish"), f"Source:\n{source}\n\nDraft:\n{draft}")


def check_messages(source: str, output: str, glossary: str) -> list[dict[str, str]]:
    """Judging: the source, the translation and the approved terms."""
    return slots(prompt("check"), f"Source:\n{source}\n\nTranslation:\n{output}", approved_terms=glossary)


def fix_messages(source: str, failed: str, issues: list[str], glossary: str) -> list[dict[str, str]]:
    """Mending: the source, the translation that failed, its high issues and the terms."""
    listed = "\n".join(f"- {i}" for i in issues)
    return slots(prompt("fix"), f"Source:\n{source}\n\nTranslation:\n{failed}\n\nIssues:\n{listed}", glossary=glossary)


class Counted:
    """A provider whose calls' tokens are added up: prompt and completion."""

    def __init__(self, provider: Provider):
        self.provider, self.prompt, self.completion = provider, 0, 0

    def ask(self, messages: list[dict[str, str]]) -> str:
        answer = completed(self.provider, messages)
        self.prompt += sum(tokens(m["content"]) for m in messages)
        self.completion += tokens(answer)
        return answer


def judged(judge: Counted | None, source: str, output: str, glossary: str) -> tuple[str, list[dict]]:
    """'fail' if the judge names a high issue or can't be read."""
    if judge is None:
        return "pass", []
    answer = judge.ask(check_messages(source, output, glossary))
    try:
        issues = json.loads(json_in(answer) or "")["issues"]
        return ("fail" if any(i["severity"] == "high" for i in issues) else "pass"), issues
    except (ValueError, KeyError, TypeError):
        return "fail", [{"issue": "unreadable", "severity": "high"}]


def glossaries(chunks: DataFrame, forms: DataFrame) -> DataFrame:
    """(book_id, chunk_id, glossary): the lines of the forms that a chunk holds, in the order of ``ord``; chunks without any are left out.

    Only what a chunk needs goes to it, not the book's whole glossary.
    """
    keyed = chunks.select(F.struct("book_id", "chunk_id").alias("chunk"), "text")
    entities = forms.select(F.struct("book_id", "ord", "line").alias("entity_id"), "source")
    found = relevant_entities(keyed, entities, "chunk", "text").where(F.col("chunk.book_id") == F.col("entity_id.book_id"))
    lines = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("entity_id.ord", "entity_id.line"))), lambda x: x["line"]))
    return found.groupBy("chunk").agg(F.array_join(lines, "\n").alias("glossary")).select("chunk.*", "glossary")


def translate(chunks: DataFrame, forms: DataFrame, translator: Callable[[], Provider], judge: Callable[[], Provider] | None = None, summariser: Callable[[], Provider] | None = None, t: Translation = Translation(), polisher: Callable[[], Provider] | None = None) -> DataFrame:
    """A row an attempt of each chunk that is not completed yet.

    chunks: book_id, spine_index, chunk_index, chunk_id, text, classification, status, summary and
    translated_text (of completed ones).  forms: book_id, ord, source, line (a glossary line).  The
    first attempt drafts and, with a ``polisher``, polishes; later ones mend the issues of the one
    before.  The last attempt is the selected one, whatever the earlier ones' issues; a chunk that
    fails its gates is kept and the book goes on; a provider that fails for good ends its book with an
    error row.  passes counts the calls that made the text, the token counts are those of all calls
    of the attempt.
    """
    joined = chunks.join(glossaries(chunks.where(F.coalesce(F.col("status"), F.lit("")) != "completed"), forms), ["book_id", "chunk_id"], "left")
    columns = [f.split()[0] for f in SCHEMA.split(", ")]

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        made = {name: Counted(make()) if make else None for name, make in (("draft", translator), ("polish", polisher), ("judge", judge), ("tell", summariser))}
        rows, summaries, before, last = [], [], None, ""

        def used() -> tuple[int, int]:
            return sum(c.prompt for c in made.values() if c), sum(c.completion for c in made.values() if c)

        for c in pdf.sort_values(["spine_index", "chunk_index"]).itertuples(index=False):
            if c.status == "completed":
                if c.summary:
                    summaries.append((c.chunk_id, c.summary))
                before, last = c, getattr(c, "translated_text", None) or ""
                continue
            glossary = c.glossary if isinstance(c.glossary, str) else ""
            over = before if t.overlap and before is not None and last and (t.across_documents or before.spine_index == c.spine_index) else None
            attempts, issues, start = [], [], used()
            try:
                for n in range(1, t.qa_retries + 2):
                    if n == 1:
                        thoughts, mark, text = made["draft"].ask(draft_messages(c.text, glossary, window(summaries, t.summary_budget), (over.text, last) if over is not None else None)).rpartition(END)
                        text, passes = text.strip(), 1
                        if mark and made["polish"]:
                            text, passes = made["polish"].ask(polish_messages(c.text, text)).strip(), 2
                    else:
                        text, mark, passes = made["draft"].ask(fix_messages(c.text, text, [i["issue"] for i in issues], glossary)).rpartition(END)[2].strip(), True, passes + 1
                    first = gate(c.text, text, t) if mark else "no boundary"
                    verdict, found = judged(made["judge"], c.text, text, glossary) if first == "ok" else ("fail", [{"issue": first, "severity": "high"}])
                    issues = [i for i in found if i["severity"] == "high"]
                    now = used()
                    attempts.append([c.book_id, c.chunk_id, n, text, thoughts, verdict, json.dumps(found), False, None, over.chunk_id if over is not None else None, None, passes, now[0] - start[0], now[1] - start[1]])
                    start = now
                    if verdict == "pass":
                        break
                attempts[-1][7] = True
                if made["tell"] and attempts[-1][5] == "pass" and c.classification in SUMMARISED:
                    attempts[-1][8] = made["tell"].ask([{"role": "user", "content": text}])
                    summaries.append((c.chunk_id, attempts[-1][8]))
                    attempts[-1][12] += used()[0] - start[0]
                    attempts[-1][13] += used()[1] - start[1]
            except (RetryLater, Refused) as e:
                rows += [*attempts, [c.book_id, c.chunk_id, len(attempts) + 1, None, None, "error", "[]", False, None, None, str(e), 0, used()[0] - start[0], used()[1] - start[1]]]
                break
            rows += attempts
            before, last = c, text
        return pd.DataFrame(rows, columns=columns)

    return joined.groupBy("book_id").applyInPandas(book, SCHEMA)


def usage(attempts: DataFrame) -> DataFrame:
    """A row a book: attempts, chunks, tokens of prompts and answers, and tokens a chunk."""
    total = attempts.groupBy("book_id").agg(F.count("*").alias("n_attempts"), F.countDistinct("chunk_id").alias("n_chunks"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    return total.withColumn("tokens_a_chunk", F.try_divide(F.col("prompt_tokens") + F.col("completion_tokens"), F.col("n_chunks")))
