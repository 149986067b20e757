"""DuckDB SQL for the rows of each query, written from its meaning and not from its plan."""

from __future__ import annotations

from ..sources.connectors import KEEP_TOKENS

EMAIL = r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"
CARD = r"\b\d(?:[ -]?\d){12,15}\b"


def luhn(digits: str) -> str:
    d = f"CAST(substr({digits}, length({digits}) - k, 1) AS INTEGER)"
    return f"list_sum(list_transform(range(0, length({digits})), lambda k: CASE WHEN k % 2 = 0 THEN {d} WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)) % 10 = 0"


def hits(pattern: str) -> str:
    """(doc_id, source, start, value) of a pattern over documents."""
    return f"""
        SELECT doc_id, source, CAST(list_sum(list_transform(g[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, h[i] AS value
        FROM (SELECT doc_id, source, g, h, unnest(range(1, len(h) + 1)) AS i
              FROM (SELECT doc_id, source, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}') AS h FROM documents))"""


CARDS = f"SELECT * FROM ({hits(CARD)}) WHERE {luhn('regexp_replace(value, $$[ -]$$, $$$$, $$g$$)')}"
BOTH = f"SELECT 'EMAIL' AS type, 'EMAIL' AS label, doc_id, source FROM ({hits(EMAIL)}) UNION ALL SELECT 'CARTE_BANCAIRE', 'CARTE', doc_id, source FROM ({CARDS})"

KEY6 = "lpad(CAST(c_custkey AS VARCHAR), 6, '0')"
BODY = f"CAST('1800374' || {KEY6} AS BIGINT)"
NIR = f"'1800374' || {KEY6} || lpad(CAST((96 - {BODY} % 97 + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) % 97 + 1 AS VARCHAR), 2, '0')"


def spans(table: str, key: str, kind: str, start: str, value: str, where: str = "true") -> str:
    return f"""SELECT CAST({key} AS BIGINT) AS id, {kind} AS type, CAST({start} AS INTEGER) AS start,
        CAST({start} + length({value}) AS INTEGER) AS "end", {value} AS value FROM {table} WHERE {where}"""


MAIL = "'c' || o_orderkey % 7 || '@mail.fr'"
DAY = "strftime(o_orderdate, '%d/%m/%Y')"
ORDER_TEXT = f"'Suivi REF-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || ' du ' || {DAY} || ', ecrire a ' || {MAIL}"
NUMBERED = f"""SELECT dossier_id, surface, row_number() OVER (PARTITION BY dossier_id ORDER BY first) AS number
    FROM (SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, {MAIL} AS surface, min(o_orderkey) AS first FROM orders GROUP BY ALL)"""


def token(label: str, number: str) -> str:
    return f"'[{label}_' || CASE WHEN {number} < 1000 THEN lpad(CAST({number} AS VARCHAR), 3, '0') ELSE CAST({number} AS VARCHAR) END || ']'"


def reply(email: str) -> str:
    return f"'Vu ' || {email} || ' et ' || CASE WHEN o_orderkey % 3 = 0 THEN '[PLAQUE_009]' ELSE '[PLAQUE_001]' END"


SEEN = "CASE o_orderkey % 4 WHEN 0 THEN '[EMAIL_001]' WHEN 1 THEN 'email_001' WHEN 2 THEN '[EMIAL_001]' ELSE 'EMAL-1' END"
REPAIRED = "CASE o_orderkey % 4 WHEN 2 THEN '[EMIAL_001]' ELSE '[EMAIL_001]' END"
PERSON = "['Jean Dupont', 'M. Dupont', 'Marie Dupont', 'Mme Dupont', 'J. Martin', 'Paul Martin'][o_orderkey % 6 + 1]"

MEASURED = """SELECT 'EMAIL' AS type, count(*) AS n_true, count(*) FILTER (o_orderkey % 4 <> 0) AS n_covered,
        count(*) FILTER (o_orderkey % 4 <> 0) + count(*) FILTER (o_orderkey % 10 = 1) AS n_found, count(*) FILTER (o_orderkey % 4 <> 0) AS n_correct FROM orders"""
IBAN_OK = "CAST('30003' || lpad(CAST(c_custkey AS VARCHAR), 18, '0') || '1527' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1"
PAIR = """CASE o_custkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Jean Dupont' ELSE 'M. Dupont' END
    WHEN 1 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Mme Dupont' ELSE 'M. Dupont' END ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Jean Paul Dupont' ELSE 'Jean Marc Dupont' END END"""
PAIRED = f"SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, o_custkey % 3 AS third, {PAIR} AS surface, min(o_orderkey) AS first FROM orders GROUP BY ALL"

ORACLES = {
    "detect_email": f'SELECT doc_id, start, CAST(start + length(value) AS INTEGER) AS "end", value FROM ({hits(EMAIL)})',
    "detect_card": f"SELECT doc_id, start, value FROM ({CARDS})",
    "count_by_type": f"SELECT type, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM ({BOTH}) GROUP BY type",
    "count_by_source": f"SELECT source, type, count(*) AS n FROM ({BOTH}) GROUP BY source, type",
    "labels_of_types": f"SELECT label, count(*) AS n FROM ({BOTH}) GROUP BY label",
    "luhn_siren": f"SELECT c_custkey, {luhn('lpad(CAST(c_custkey AS VARCHAR), 9, $$0$$)')} AS valid FROM customer",
    "luhn_siret": f"SELECT c_custkey, {luhn('lpad(CAST(c_custkey AS VARCHAR), 14, $$0$$)')} AS valid FROM customer",
    "nir_keys": f"SELECT c_custkey, 97 - {BODY} % 97 AS key FROM customer",
    "nir_corsica": f"""SELECT c_custkey, 97 - (CAST('1800320' || {KEY6} AS BIGINT) - CASE WHEN c_custkey % 2 = 0 THEN 1000000 ELSE 2000000 END) % 97 AS key FROM customer""",
    "nir_check": "SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM customer",
    "iban_mod97": "SELECT c_custkey, CAST('30003' || lpad(CAST(c_custkey AS VARCHAR), 18, '0') || '1527' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') AS HUGEINT) % 97 = 1 AS valid FROM customer",
    "suspect_with_context": spans("customer", "c_custkey", "CASE WHEN c_custkey % 3 = 0 THEN 'FR_NIR_SUSPECT' ELSE 'FR_NIR' END", "6", NIR),
    "suspect_without_context": spans("customer", "c_custkey", "'FR_NIR'", "5", NIR, "c_custkey % 3 <> 0"),
    "context_blank_line": spans("customer", "c_custkey", "'RPPS'", "8", "'1' || lpad(CAST(c_custkey AS VARCHAR), 10, '0')", "c_custkey % 2 = 1"),
    "matricule_context": spans("customer", "c_custkey", "'MATRICULE'", "10", f"{KEY6} || '-77'", "c_custkey % 2 = 0"),
    "phone": spans("customer", "c_custkey", "'TELEPHONE'", "4", r"'06 ' || regexp_replace(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '(..)(..)(..)(..)', '\1 \2 \3 \4')"),
    "plate": spans("customer", "c_custkey", "'PLAQUE'", "9", "'AB-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-CD'"),
    "reference": spans("customer", "c_custkey", "'REFERENCE_DOSSIER'", "8", "'DOS-2024-' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0')"),
    "dates": spans("orders", "o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN 'DATE_NAISSANCE' ELSE 'DATE_PROCEDURALE' END", "CASE WHEN o_orderkey % 2 = 0 THEN 20 ELSE 10 END", DAY),
    "postcode": spans("customer", "c_custkey", "'CODE_POSTAL'", "3", "lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0')", "c_custkey % 2 = 0"),
    "overlap_priority": spans("supplier", "s_suppkey", f"CASE WHEN {luhn('lpad(CAST(s_suppkey AS VARCHAR), 14, $$0$$)')} THEN 'FR_SIRET' ELSE 'FR_SIRET_SUSPECT' END", "6", "lpad(CAST(s_suppkey AS VARCHAR), 14, '0')"),
    "merged_spans": """SELECT o_orderkey, CAST(0 AS INTEGER) AS start, CAST(9 AS INTEGER) AS "end", CAST(0.6 AS DOUBLE) AS score FROM orders WHERE o_orderkey % 2 = 0
        UNION ALL SELECT o_orderkey, 0, 4, 0.9 FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 5, 9, 0.6 FROM orders WHERE o_orderkey % 2 = 1""",
    "policy_actions": """SELECT type, action, count(*) AS n FROM (
        SELECT 'EMAIL' AS type, CASE WHEN o_custkey % 3 = 0 THEN 'masquer' ELSE 'pseudonymiser' END AS action FROM orders
        UNION ALL SELECT 'REFERENCE_DOSSIER', CASE WHEN o_custkey % 3 = 0 THEN 'revue' ELSE 'pseudonymiser' END FROM orders
        UNION ALL SELECT 'DATE_PROCEDURALE', 'conserver' FROM orders) GROUP BY type, action""",
    "numbering": f"SELECT dossier_id, surface, {token('EMAIL', 'number')} AS placeholder, number FROM ({NUMBERED})",
    "numbering_incremental": NUMBERED,
    "vault_batches": NUMBERED,
    "protected_texts": f"""SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, o_orderkey AS seq,
        'Suivi ' || {token("REFERENCE", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")} || ' du ' || {DAY} || ', ecrire a '
            || CASE WHEN o_custkey % 3 = 0 THEN '[EMAIL]' ELSE {token("EMAIL", "number")} END AS protected
        FROM orders JOIN ({NUMBERED}) ON dossier_id = CAST(o_custkey AS VARCHAR) AND surface = {MAIL}""",
    "reidentify_roundtrip": f"SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, o_orderkey AS seq, {ORDER_TEXT} AS restored FROM orders",
    "mode_separation": """SELECT CAST(c_custkey AS VARCHAR) AS dossier_id, CASE WHEN c_custkey % 3 = 0 THEN 'demo' ELSE 'serieux' END AS mode,
        CASE WHEN c_custkey % 3 = 0 THEN 'demo_refused' WHEN c_custkey % 2 = 1 THEN 'conflict' END AS refused FROM customer""",
    "purge_vault": f"SELECT dossier_id, count(*) AS n FROM ({NUMBERED}) WHERE CAST(dossier_id AS BIGINT) % 2 = 1 GROUP BY dossier_id",
    "normalize_tokens": f"SELECT o_orderkey, {reply(SEEN)} AS text FROM orders",
    "restore_altered": f"SELECT o_orderkey, {reply(REPAIRED)} AS text FROM orders",
    "integrity_report": """SELECT o_orderkey, o_orderkey % 4 <> 2 AND o_orderkey % 3 <> 0 AS ok,
        concat_ws(',', CASE WHEN o_orderkey % 4 = 2 THEN '[EMIAL_001]' END, CASE WHEN o_orderkey % 3 = 0 THEN '[PLAQUE_009]' END) AS unknown,
        concat_ws(',', CASE WHEN o_orderkey % 4 = 2 THEN '[EMAIL_001]' END, CASE WHEN o_orderkey % 3 = 0 THEN '[PLAQUE_001]' END) AS missing FROM orders""",
    "leak_check": f"SELECT {MAIL} AS value, count(*) AS n_leaks FROM orders WHERE o_orderkey % 50 = 0 GROUP BY ALL",
    "eval_recall_precision": f"SELECT *, n_covered / n_true AS recall, n_correct / n_found AS precision FROM ({MEASURED})",
    "markdown_report": f"SELECT type, printf('| %s | %.1f %% (%d/%d) | %.1f %% (%d/%d) |', type, n_covered * 100.0 / n_true, n_covered, n_true, n_correct * 100.0 / n_found, n_correct, n_found) AS line FROM ({MEASURED})",
    "judge_strict_parse": """SELECT o_orderkey AS seq, CAST(CASE WHEN o_orderkey % 5 IN (0, 2) OR o_orderkey % 2 = 1 THEN 0 ELSE 1 END AS INTEGER) AS n,
        CASE WHEN o_orderkey % 5 IN (0, 2) THEN 'SortieJugeInvalide' END AS error_kind FROM orders""",
    "judge_locate": f"""SELECT o_orderkey AS seq, CAST(instr({ORDER_TEXT}, {MAIL}) - 1 AS INTEGER) AS start,
        CAST(instr({ORDER_TEXT}, {MAIL}) - 1 + length({MAIL}) AS INTEGER) AS "end", CAST(0.9 AS DOUBLE) AS score FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 5 NOT IN (0, 2)""",
    "judge_last_message": "SELECT conv_id, max(turn) AS turn, CAST(length(arg_max(text, turn)) AS INTEGER) AS n_chars FROM conversations GROUP BY conv_id",
    "conversation_gateway": """SELECT CAST(conv_id AS VARCHAR) AS dossier_id, CASE WHEN count(DISTINCT turn % 2) = 2 THEN '[EMAIL_001],[EMAIL_002]' ELSE '[EMAIL_001]' END AS sent,
        conv_id % 3 <> 0 AS ok, CASE WHEN conv_id % 3 = 0 THEN '[PLAQUE_009]' ELSE '' END AS unknown,
        CASE WHEN conv_id % 3 <> 0 THEN md5(arg_max(text || ' Ecrire a c' || turn % 2 || '@mail.fr', turn)) END AS answer_md5 FROM conversations GROUP BY conv_id""",
    "audit_events": f"""SELECT 'r' || conv_id AS request_id, CAST(conv_id AS VARCHAR) AS dossier_id, 'echo' AS backend, 'ok' AS status,
        CAST(sum(length(text) + length(' Ecrire a [EMAIL_001]')) + length('{KEEP_TOKENS.replace("'", "''")}') AS BIGINT) AS approximate_size, CAST(count(*) AS INTEGER) AS n_email FROM conversations GROUP BY conv_id""",
    "name_engine": f"""SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, o_orderkey AS seq, 'PERSONNE' AS type, CAST(15 AS INTEGER) AS start, CAST(15 + length({PERSON}) AS INTEGER) AS "end", {PERSON} AS surface FROM orders
        UNION ALL SELECT CAST(o_custkey AS VARCHAR), o_orderkey, 'LIEU', CAST(18 + length({PERSON}) AS INTEGER), CAST(23 + length({PERSON}) AS INTEGER), 'Paris' FROM orders""",
    "canaries": """SELECT CAST(item_id AS VARCHAR) AS doc_id, 'quoted' AS canary, item_id % 2 = 0 AS signaled FROM benchmark
        UNION ALL SELECT CAST(item_id AS VARCHAR), 'reworded', len(string_split(text, ' ')) > 12 FROM benchmark""",
    "extracted_files": """SELECT '/in/' || page_id || ['.txt', '.MD', '.exe', '.csv'][page_id % 4 + 1] AS path,
        CASE WHEN page_id % 4 <> 2 THEN url END AS text, CASE WHEN page_id % 4 = 2 THEN 'FormatNonSupporte' END AS error_kind FROM pages""",
    "siren_context": spans("customer", "c_custkey", f"CASE WHEN {luhn('lpad(CAST(c_custkey AS VARCHAR), 9, $$0$$)')} THEN 'FR_SIREN' ELSE 'FR_SIREN_SUSPECT' END", "6", "lpad(CAST(c_custkey AS VARCHAR), 9, '0')"),
    "iban_context": spans("customer", "c_custkey", f"CASE WHEN {IBAN_OK} THEN 'IBAN' ELSE 'IBAN_SUSPECT' END", "4", "'FR' || lpad(CAST(c_custkey % 97 + 2 AS VARCHAR), 2, '0') || '30003' || lpad(CAST(c_custkey AS VARCHAR), 18, '0')"),
    "born_dates": spans("orders", "o_orderkey", "'DATE_NAISSANCE'", "CASE WHEN o_orderkey % 2 = 0 THEN 19 ELSE 16 END", DAY),
    "glued_dates": spans("orders", "o_orderkey", "'DATE_PROCEDURALE'", "3", DAY),
    "policy_override": """SELECT c_custkey, type, CASE WHEN type = 'DATE_PROCEDURALE' THEN 'conserver' WHEN type = 'IBAN' THEN 'revue'
        WHEN type = 'EMAIL' THEN CASE WHEN c_custkey % 2 = 0 THEN 'conserver' ELSE 'masquer' END
        WHEN c_custkey % 2 = 0 THEN 'masquer' ELSE 'pseudonymiser' END AS action
        FROM customer, (VALUES ('EMAIL'), ('IBAN'), ('PLAQUE'), ('DATE_PROCEDURALE')) AS t(type)""",
    "policy_replaced": """SELECT CAST(c_custkey AS VARCHAR) AS dossier_id, 'IBAN' AS type, 'masquer' AS action FROM customer WHERE c_custkey % 6 = 0
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), type, action FROM customer, (VALUES ('EMAIL', 'masquer'), ('REFERENCE_DOSSIER', 'revue')) AS t(type, action) WHERE c_custkey % 6 = 3""",
    "serious_projection": f"""SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, o_orderkey AS seq, CAST(instr({ORDER_TEXT}, {MAIL}) - 1 AS INTEGER) AS start,
        CAST(instr({ORDER_TEXT}, {MAIL}) - 1 + length({MAIL}) AS INTEGER) AS "end", CAST(0.95 AS DOUBLE) AS score FROM orders""",
    "vault_lookup": f"SELECT dossier_id, surface, {token('EMAIL', 'number')} AS placeholder FROM ({NUMBERED})",
    "vault_aliases": f"""WITH n AS ({NUMBERED}) SELECT dossier_id, surface, {token('EMAIL', 'number')} AS placeholder, CASE WHEN number = 1 THEN 'alias-' || surface ELSE surface END AS value FROM n
        UNION ALL SELECT dossier_id, 'alias-' || surface, '[EMAIL_001]', 'alias-' || surface FROM n WHERE number = 1""",
    "vault_sealed": """SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN 'c' || c_custkey || '@mail.fr' END AS surface, CAST(NULL AS VARCHAR) AS alias,
        CASE WHEN c_custkey % 5 > 0 THEN false END AS shows FROM customer""",
    "counts_of_dossiers": """SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, type, CAST(count(*) AS INTEGER) AS n
        FROM orders, (VALUES ('EMAIL'), ('REFERENCE_DOSSIER'), ('DATE_PROCEDURALE')) AS t(type) GROUP BY ALL""",
    "audited_reidentification": f"SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, o_orderkey AS seq, {ORDER_TEXT} AS restored, CAST(2 * count(*) OVER (PARTITION BY o_custkey) AS INTEGER) AS n_in_dossier FROM orders",
    "coreference_pairs": f"""SELECT dossier_id, surface, CASE WHEN third = 0 THEN 1 ELSE row_number() OVER (PARTITION BY dossier_id ORDER BY first) END AS number,
        CASE WHEN third = 0 AND count(*) OVER (PARTITION BY dossier_id) = 2 THEN 'Jean Dupont' ELSE surface END AS canonical, false AS ambiguous FROM ({PAIRED})""",
    "coreference_ambiguous": """SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, ['Jean Dupont', 'Marie Dupont', 'M. Dupont'][n] AS surface, n AS number,
        ['Jean Dupont', 'Marie Dupont', 'M. Dupont'][n] AS canonical, n = 3 AS ambiguous
        FROM (SELECT o_custkey, unnest(range(1, least(count(*), 3) + 1)) AS n FROM orders GROUP BY o_custkey)""",
    "judged_texts": """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN '' ELSE '0:5' END AS located,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Refused' WHEN o_orderkey % 7 = 0 THEN 'SortieJugeInvalide' END AS error_kind FROM orders""",
    "streamed_people": f"""SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, o_orderkey AS seq, 'Vu par ' || token AS protected
        FROM orders JOIN (SELECT dossier_id, surface, '[PERSONNE_00' || CASE WHEN third = 0 THEN 1 ELSE row_number() OVER (PARTITION BY dossier_id ORDER BY first) END || ']' AS token FROM ({PAIRED}))
        ON dossier_id = CAST(o_custkey AS VARCHAR) AND surface = {PAIR}""",
    "coreference_casing": """WITH n AS (SELECT o_custkey, o_custkey % 3 AS k, count(*) AS n FROM orders GROUP BY o_custkey)
        SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, names[i] AS surface, CAST(1 AS BIGINT) AS number, CASE WHEN n = 1 OR k = 0 THEN names[1] ELSE names[2] END AS canonical
        FROM (SELECT *, [['M. dupont', 'Dupont'], ['m. dupont', 'Dupont'], ['jean dupont', 'Jean Dupont']][k + 1] AS names, unnest(range(1, least(n, 2) + 1)) AS i FROM n)""",
    "surrogate_properties": f"""SELECT dossier_id, CASE WHEN any_value(third) = 0 THEN 1 ELSE count(*) END AS n_people, CASE WHEN any_value(third) = 0 THEN 1 ELSE count(*) END AS n_names,
        CAST(0 AS BIGINT) AS n_real FROM ({PAIRED}) GROUP BY dossier_id""",
    "surrogate_roundtrip": f"""SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, o_orderkey AS seq, false AS before, 'Vu par ' || token || ' et ' || token AS text
        FROM orders JOIN (SELECT dossier_id, surface, '[PERSONNE_00' || CASE WHEN third = 0 THEN 1 ELSE row_number() OVER (PARTITION BY dossier_id ORDER BY first) END || ']' AS token FROM ({PAIRED}))
        ON dossier_id = CAST(o_custkey AS VARCHAR) AND surface = {PAIR}""",
    "docx_rewritten": f"""SELECT dossier_id, string_agg(protected, chr(10) ORDER BY seq) AS text, CAST(count(*) AS INTEGER) AS n_email FROM (
        SELECT CAST(o_custkey AS VARCHAR) AS dossier_id, o_orderkey AS seq, 'Suivi ' || {token("REFERENCE", "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)")} || ' du ' || {DAY} || ', ecrire a ' || {token("EMAIL", "number")} AS protected
        FROM orders JOIN ({NUMBERED}) ON dossier_id = CAST(o_custkey AS VARCHAR) AND surface = {MAIL}) GROUP BY dossier_id""",
    "chat_requests": """SELECT CAST(conv_id AS VARCHAR) AS dossier_id, CASE WHEN conv_id % 7 < 4 THEN 'RequeteInvalide' END AS error_kind, CASE WHEN conv_id % 7 > 3 THEN 'm' END AS model,
        CASE WHEN conv_id % 7 > 3 THEN md5(arg_max(text || ' Ecrire a c' || turn % 2 || '@mail.fr', turn)) END AS answer_md5, conv_id % 7 > 3 AND conv_id % 2 = 0 AS streamed FROM conversations GROUP BY conv_id""",
    "documents_pseudonymized": f"""WITH found AS (
          SELECT doc_id, source, start, value, 'EMAIL' AS label FROM ({hits(EMAIL)}) UNION ALL SELECT doc_id, source, start, value, 'CARTE' FROM ({CARDS})),
        numbered AS (SELECT source, label, value, row_number() OVER (PARTITION BY source, label ORDER BY first, value) AS n
          FROM (SELECT source, label, value, min(struct_pack(d := doc_id, s := start)) AS first FROM found GROUP BY ALL)),
        cut AS (SELECT doc_id, label, start, length(value) AS size, '[' || label || '_' || lpad(CAST(n AS VARCHAR), CAST(greatest(3, length(CAST(n AS VARCHAR))) AS INTEGER), '0') || ']' AS token,
            coalesce(lag(start + length(value)) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM found JOIN numbered USING (source, label, value)),
        joined AS (SELECT doc_id, string_agg(substr(text, before + 1, start - before) || token, '' ORDER BY start) || substr(any_value(text), max(start + size) + 1) AS protected,
            count(*) FILTER (label = 'EMAIL') AS n_email FROM cut JOIN documents USING (doc_id) GROUP BY doc_id)
        SELECT source AS dossier_id, doc_id AS seq, sha256(coalesce(protected, text)) AS protected_sha256, CAST(coalesce(n_email, 0) AS INTEGER) AS n_email FROM documents LEFT JOIN joined USING (doc_id)""",
}
