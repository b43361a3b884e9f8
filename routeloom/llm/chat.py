"""Chat formatting with a grammar round trip.

    turn := "<|im_start|>" header "\\n" body "<|im_end|>\\n"      header := role [ "|" level ]

A plain role of letters, digits, "_" and "-" stands as it is, any other as a JSON string. A body at level 0 is the text.
Control strings may not occur in a body. `render` writes a turn, reparses it and compares the result with the source;
while they differ it escapes more: level 1 doubles backslashes and puts one behind the first character of each control
string, level 2 writes the text as a JSON string in ASCII without "<" and "[".
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm.common import bounded_batches, table

START, END = "<|im_start|>", "<|im_end|>"
#: The marks of common chat templates, none of which a text may bring into the output.
CONTROLS = (START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ROLE = re.compile(r"[A-Za-z0-9_-]*\Z")
LOSS_ROLE = "assistant"


class GrammarError(ValueError):
    pass


def escape(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))
    return json.dumps(text).replace("<", "\\u003c").replace("[", "\\u005b")


def unescape(body: str, level: int) -> str:
    if level == 0:
        return body
    if level == 1:
        return re.sub(r"\\(\\?)", r"\1", body)
    return json.loads(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of every turn; start and end bound the body. Raises GrammarError on anything else."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise GrammarError(f"no turn at {at}")
        line = formatted.find("\n", at)
        if line < 0:
            raise GrammarError(f"no header at {at}")
        role, bar, level = formatted[at + len(START) : line].rpartition("|")
        if not bar:
            role, level = level, "0"
        if level not in ("0", "1", "2"):
            raise GrammarError(f"no level at {at}")
        if role.startswith('"'):
            role = json.loads(role)
        elif not _ROLE.match(role):
            raise GrammarError(f"no role at {at}")
        m = _CONTROL.search(formatted, line + 1)
        if m is None or m[0] != END or not formatted.startswith("\n", m.end()):
            raise GrammarError(f"control string in the turn at {at}")
        turns.append((role, unescape(formatted[line + 1 : m.start()], int(level)), line + 1, m.start()))
        at = m.end() + 1
    return turns


def render(role: str, text: str) -> tuple[str, int]:
    """The turn, and the least level at which reparsing gives the same role and text."""
    name = role if _ROLE.match(role) else json.dumps(role).replace("|", "\\u007c").replace("<", "\\u003c").replace("[", "\\u005b")
    for level in (0, 1, 2):
        out = f"{START}{name}{f'|{level}' if level else ''}\n{escape(text, level)}{END}\n"
        try:
            if [t[:2] for t in parse(out)] == [(role, text)]:
                return out, level
        except (GrammarError, ValueError):
            continue
    raise GrammarError("the turn can't be written")


def format_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, formatted, level), a row per turn; a conversation's output is its rows' formatted texts in order.

    Null roles and texts count as empty. Rendering and its round trip go row by row, wherever the row is.
    """
    bounded_batches(conversations.sparkSession)

    @F.pandas_udf("struct<formatted:string,level:int>")
    def turns(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([render(r, t) for r, t in zip(roles, texts)], columns=["formatted", "level"])

    c = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return c.select("conv_id", "turn", turns("role", "text").alias("t")).select("conv_id", "turn", "t.formatted", "t.level")


_DIGESTS = "conv_id {0}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, escaped_turns long, loss_spans long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Reparses format_turns' output, conversation by conversation, into digests of its turns and of its loss mask.

    Turns go by turn (null first), then by formatted text, so repeated turn numbers have one order. The conversations
    of a partition stream through in order and only running digests are held, however long one is; an id of null is
    one conversation. An empty table gives no rows.
    """
    kind = dict(formatted.dtypes)["conv_id"]
    schema = _DIGESTS.format(kind)

    def digests(batches):
        current, state = None, None

        def result():
            return [current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]]

        for b in batches:
            done = []
            for conv, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if current != (conv,):
                    if current is not None:
                        done.append(result())
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                state[4] += len(text)
                for role, said, start, end in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                    state[5] += "|" in text[len(START) : text.index("\n")]
                    if role == LOSS_ROLE:
                        state[2] += len(said)
                        state[3].update(said.encode())
                        state[6] += end > start
            if done:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*done)))), schema=arrow)
        if current is not None:
            yield pa.RecordBatch.from_pydict(dict(zip(names, [[x] for x in result()])), schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    names = arrow.names
    n = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = formatted.select("conv_id", "turn", "formatted").repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "formatted")
    return rows.mapInArrow(digests, schema)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_back(format_turns(c.unionByName(own))).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "escaped_turns")
