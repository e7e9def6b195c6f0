"""Chat formatting by incremental rendering of a template taken as a black box."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table

Turn = tuple[str, str]
START, END = "<|im_start|>", "<|im_end|>"
#: With a number, stands in for a text while its place in the output is looked for.
PROBE = "probe"


class Template(Protocol):
    """What the operator needs of a template: rendering, and reading back what it wrote."""

    def render(self, turns: list[Turn]) -> str: ...

    def unescape(self, text: str) -> str: ...

    def parse(self, output: str) -> list[Turn]: ...


class MarkedTurns:
    """Turns between start and end marks; a backslash hides control strings inside texts.

    Backslashes double and ``<|`` becomes ``<\\|``, so no mark can occur inside
    a text, and undoing each backslash gives the text back.
    """

    def render(self, turns: list[Turn]) -> str:
        return "".join(f"{START}{self.escape(role).replace(chr(10), chr(92) + 'n')}\n{self.escape(text)}{END}\n" for role, text in turns)

    def escape(self, text: str) -> str:
        return text.replace("\\", "\\\\").replace("<|", "<\\|")

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def parse(self, output: str) -> list[Turn]:
        turns = []
        for role, text in re.findall(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", output, flags=re.S):
            turns.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role), self.unescape(text)))
        return turns


def render_incrementally(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int] | None], bool]:
    """The output, the place of each turn's text in it, and whether the template rewrites history.

    Each prefix of the turns is rendered. Where an output goes on from the one
    before, the rest is the turn's span, and the text is placed in the span by
    rendering the prefix with a probe as its last text. A template rewrites
    history if some output doesn't begin with the one before; then each text
    is placed by a probe in the whole conversation, and a text that the
    template left out or changed has no place. Only the last two outputs are
    held, so memory grows with the conversation and not with its square.
    """
    before, places, rewrites = template.render([]), [], False
    for k, (role, _) in enumerate(turns):
        output = template.render(turns[: k + 1])
        if not output.startswith(before):
            rewrites = True
            break
        probe = absent_probe(output)
        places.append(place_of_text(template.render([*turns[:k], (role, probe)]), output, len(before), probe))
        before = output
    if rewrites:
        before = template.render(turns)
        probe = absent_probe(before)
        places = [place_of_text(template.render([*turns[:k], (role, probe), *turns[k + 1 :]]), before, 0, probe) for k, (role, _) in enumerate(turns)]
    return before, places, rewrites


def absent_probe(output: str) -> str:
    """A probe that output doesn't hold; no probe ends as it begins, so none arises where one adjoins output either."""
    k = 0
    while f"{PROBE}{k}" in output:
        k += 1
    return f"{PROBE}{k}"


def place_of_text(probed: str, output: str, start: int, probe: str) -> tuple[int, int] | None:
    """Where output holds the text in whose stead probed has the probe, from start on; None if all else isn't alike."""
    low = probed.find(probe, start)
    tail = len(probed) - low - len(probe)
    if low < 0 or low + tail > len(output) or output[:low] != probed[:low] or output[len(output) - tail :] != probed[low + len(probe) :]:
        return None
    return low, len(output) - tail


def format_conversations(rows: DataFrame, template: Template, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans, rewrites_history), a row for each conversation.

    Turns come by turn, then role and text; null roles and texts are empty
    strings, and a null conv_id is a conversation of its own. loss_spans holds
    the start and end, in code points of formatted, of each text of loss_role
    in order, empty texts included. Repeated rows are turns of their own; an
    empty table gives none. A conversation is one value of one row in the
    end, so it has to fit a task; rows of a conversation gather as partial
    lists.
    """
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    @F.pandas_udf("formatted string, loss_spans array<struct<start:long,end:long>>, rewrites_history boolean")
    def render(conversations: pd.Series) -> pd.DataFrame:
        made = []
        for turns in conversations:
            pairs = [(t["role"], t["text"]) for t in turns]
            text, places, rewrites = render_incrementally(template, pairs)
            spans = [{"start": p[0], "end": p[1]} for (role, _), p in zip(pairs, places, strict=True) if p and role == loss_role]
            made.append((text, spans, rewrites))
        return pd.DataFrame(made, columns=["formatted", "loss_spans", "rewrites_history"])

    done = whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), render("turns").alias("r"))
    return done.select("conv_id", "n_turns", "r.*")


def digest(formatted: DataFrame, template: Template) -> DataFrame:
    """What reading formatted conversations back gives: turns and the text under the loss mask, as digests."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def read(outputs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for texts, masks in outputs:
            made = []
            for text, spans in zip(texts, masks, strict=True):
                turns = template.parse(text)
                loss = "".join(template.unescape(text[s["start"] : s["end"]]) for s in spans)
                made.append((len(turns), sha("".join(f"{role}\n{said}\n" for role, said in turns)), len(loss), sha(loss), len(text)))
            yield pd.DataFrame(made, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", read("formatted", "loss_spans").alias("d")).select("conv_id", "d.*")


SAID = f"{END}{START}assistant ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one (-1) whose texts hold control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)], "conv_id long, turn long, role string, text string")
    template = MarkedTurns()
    return digest(format_conversations(rows.unionByName(extra), template), template)


def op3_sql() -> str:
    """The same as DuckDB SQL."""
    escape = lambda c: rf"replace(replace({c}, '\', '\\'), '<|', '<\|')"
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS said FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{SAID}' UNION ALL SELECT -1, 1, 'assistant', '{SAID}'
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || said || chr(10), '' ORDER BY turn, role, said)) AS turns_sha256,
  CAST(coalesce(sum(length(said)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY turn, role, said) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(replace({escape("role")}, chr(10), '\n')) + length({escape("said")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""
