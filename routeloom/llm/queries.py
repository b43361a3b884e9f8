"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

import re

from routeloom.llm import codes, negatives, rules
from routeloom.llm.chat import CONTROLS, END, START, op3_chat
from routeloom.llm.codes import op12_codes
from routeloom.llm.gif import op1_gif
from routeloom.llm.hashing import op8_hashing
from routeloom.llm.mixing import op5_mixing
from routeloom.llm.negatives import op13_negatives
from routeloom.llm.packing import op4_packing
from routeloom.llm.pieces import op10_pieces
from routeloom.llm.quality import op2_quality
from routeloom.llm.rules import op11_rules
from routeloom.llm.simhash import op6_simhash
from routeloom.llm.urls import op7_urls
from routeloom.llm.warc import ALPHABET, op9_warc

QUERIES = {
    "op1_gif": op1_gif,
    "op2_quality": op2_quality,
    "op3_chat": op3_chat,
    "op4_packing": op4_packing,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_urls": op7_urls,
    "op8_hashing": op8_hashing,
    "op9_warc": op9_warc,
    "op10_pieces": op10_pieces,
    "op11_rules": op11_rules,
    "op12_codes": op12_codes,
    "op13_negatives": op13_negatives,
}
_CONTROL = "|".join(map(re.escape, CONTROLS))
_BARE = len(START) + len(END) + 2
ORACLE_SQL: dict[str, str] = {
    "op3_chat": rf"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
      e AS (SELECT *, len(regexp_extract_all(text, '{_CONTROL}')) AS k FROM c)
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum({_BARE} + length(role) + length(text) + CASE WHEN k > 0 THEN 2 + k + length(text) - length(replace(text, '\', '')) ELSE 0 END) AS BIGINT) AS formatted_chars,
        count(*) FILTER (k > 0) AS escaped_turns FROM e GROUP BY conv_id""",
    "op9_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
      h AS (SELECT page_id, first, strlen(html) AS payload_bytes, sha1(html) AS d FROM p)
      SELECT page_id, payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('{ALPHABET}', CAST(((CAST('0x' || substr(d, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), 'string_agg', '') AS payload_digest,
        CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM h""",
    "op11_rules": rules.ORACLE,
    "op12_codes": codes.ORACLE,
    "op13_negatives": negatives.ORACLE,
}
