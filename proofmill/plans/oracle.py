"""DuckDB twins of the catalogue's queries, over the same Parquet views."""

from __future__ import annotations

from proofmill.config import Branding, ContextPolicy, EvidenceBudget, SelectionPolicy
from proofmill.functions.ids import policy_hash, text_hash
from proofmill.functions.text import STOP_WORDS

QUERY, OTHER = "the heat of ention, and the 2 eses", "leur dans le monde entier la"
BUDGET = EvidenceBudget(max_items=9, max_raw_chars=6000, max_cleaned_chars=5600, max_context_chars=9000)
TOKENS = r"'[a-z0-9]+'"

DOCS = """docs AS (
  SELECT 'doc_' || substr(sha256(source_path), 1, 12) || '_' || substr(content_hash, 1, 12) AS document_id, *
  FROM (SELECT source || '/doc_' || doc_id || (CASE WHEN doc_id % 2 = 0 THEN '.md' ELSE '.txt' END) AS source_path,
    CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'txt' END AS source_type, sha256(text) AS content_hash,
    octet_length(encode(text))::BIGINT AS size_bytes, text AS raw_text, lang, source, doc_id FROM documents)
)"""


def chunks(source: str = "docs", size: int = 1000, overlap: int = 0, search: bool = True, path: str = "source_path") -> str:
    """The chunk rows of a (document_id, raw_text) relation, by recursion over the cuts."""

    def cut(pos: str) -> str:
        end = f"least({pos} + {size}, length(raw_text))"
        if not search:
            return end
        low = f"greatest(2, {end} - 49)"
        window = f"substr(raw_text, {low} + 1, {end} - {low})"
        before = f"substr(raw_text, {low}, {end} - {low} + 1)"
        newline = f"CASE WHEN contains({window}, chr(10)) THEN {low} + length(regexp_extract({window}, '(?s)^(.*)\\n', 1)) END"
        sentence = f"CASE WHEN regexp_matches({before}, '[.!?][ \\n]') THEN {low} - 1 + length(regexp_extract({before}, '(?s)^(.*[.!?])[ \\n]', 1)) END"
        found = f"coalesce({newline}, {sentence}, {end})"
        return f"CASE WHEN {end} < length(raw_text) AND {found} > {pos} + {overlap} THEN {found} ELSE {end} END"

    return f"""cuts AS (
  SELECT document_id, {path} AS path, raw_text, 0 AS chunk_index, 0 AS start_offset, {cut("0")} AS end_offset FROM {source} WHERE length(raw_text) > 0
  UNION ALL
  SELECT document_id, path, raw_text, chunk_index + 1, end_offset - {overlap}, {cut(f"(end_offset - {overlap})")} FROM cuts WHERE end_offset < length(raw_text)
), chunks AS (
  SELECT 'chunk_' || document_id || '_' || chunk_index AS chunk_id, document_id, path, chunk_index, start_offset, end_offset,
    substr(raw_text, start_offset + 1, end_offset - start_offset) AS piece, sha256(substr(raw_text, start_offset + 1, end_offset - start_offset)) AS raw_text_hash
  FROM cuts
)"""


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def protected(line: str) -> str:
    bare = strip(line)
    return f"({bare} <> '' AND (starts_with({bare}, '---') OR starts_with({bare}, '===') OR starts_with({bare}, '|') OR ends_with({bare}, '|') OR regexp_matches({line}, '[:=]\\s{{2,}}') OR starts_with({line}, '    ') OR starts_with({line}, chr(9))))"


def refined(c: str) -> str:
    """The rule-based refinement of a column without exotic white space."""
    some = f"len(list_filter(regexp_split_to_array({c}, '\\r\\n|\\n|\\r'), lambda x: {protected('x')})) > 0"
    trimmed = f"CASE WHEN {some} THEN regexp_replace({c}, '^\\n+|\\n+$', '', 'g') ELSE {strip(c)} END"
    squeezed = f"regexp_replace({trimmed}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    lead = "regexp_extract(x, '^(\\s*)', 1)"
    line = f"CASE WHEN {protected('x')} THEN x ELSE {lead} || regexp_replace(substr(x, length({lead}) + 1), '\\s{{2,}}', ' ', 'g') END"
    return f"array_to_string(list_transform(string_split({squeezed}, chr(10)), lambda x: regexp_replace({line}, '\\s+$', '')), chr(10))"


NOISY = "'  ' || replace(replace(text, ', ', ',    '), '. ', '.' || repeat(chr(10), 4)) || '  '"
TABLED = f"CASE WHEN doc_id % 3 = 0 THEN '| a  |  b |' || chr(10) || 'key:   1,  2' || chr(10) || '    code  here' || chr(10) || ({NOISY}) ELSE {NOISY} END"

CORPUS = f"""{DOCS}, {chunks()}, corpus AS (
  SELECT c.document_id, c.chunk_id, c.chunk_index, c.path AS source_path, d.source_type, d.lang, c.piece AS raw_text, {refined("c.piece")} AS cleaned_text, c.raw_text_hash
  FROM chunks c JOIN docs d USING (document_id)
)"""


def score(tokens: str, query: str = QUERY) -> str:
    import re

    parts = [f"(CASE WHEN len(list_filter({tokens}, lambda t: t = '{w}')) > 0 THEN len(list_filter({tokens}, lambda t: t = '{w}'))::DOUBLE * 1.5 / (len(list_filter({tokens}, lambda t: t = '{w}')) + 0.5) ELSE 0 END)" for w in re.findall("[a-z0-9]+", query.lower())]
    return f"least(1.0::DOUBLE, (0.0::DOUBLE + {' + '.join(parts)}) / (1.0::DOUBLE + len({tokens}) * 0.001::DOUBLE))"


def vector(query: str = QUERY) -> str:
    return f"('0x' || substr(sha256('{query}' || ':' || chunk_id), 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE"


def has(c: str, query: str = QUERY) -> str:
    import re

    words = ", ".join(f"'{w}'" for w in dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))
    return f"list_has_any(regexp_extract_all(lower({c}), {TOKENS}), [{words}])"


SEARCH = {"raw_only": "raw_text", "cleaned_only": "cleaned_text", "dual_context": "raw_text || ' ' || cleaned_text"}
MATCHED = {"raw_only": ["raw_text"], "cleaned_only": ["cleaned_text"], "dual_context": ["raw_text", "cleaned_text"]}


def keyword(policy: str, name: str, query: str = QUERY, where: str = "true", limit: int = 40) -> str:
    fields = ", ".join(f"CASE WHEN {has(c, query)} THEN '{c}' END" for c in MATCHED[policy])
    return f"""{name} AS (
  SELECT * FROM (SELECT *, {score("toks", query)} AS keyword_score, array_to_string(list_filter([{fields}], lambda x: x IS NOT NULL), ',') AS matched
    FROM (SELECT *, regexp_extract_all(lower({SEARCH[policy]}), {TOKENS}) AS toks FROM corpus WHERE {where}))
  WHERE keyword_score > 0 ORDER BY keyword_score DESC, document_id, chunk_id LIMIT {limit}
)"""


def vectors(name: str, query: str = QUERY, where: str = "true", limit: int = 40) -> str:
    return f"{name} AS (SELECT *, {vector(query)} AS vector_score FROM corpus WHERE {where} ORDER BY vector_score DESC, document_id, chunk_id LIMIT {limit})"


def merged(name: str, alpha: float, kw: str = "kw", vec: str = "vec", top: int = 20) -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (ORDER BY hybrid_score DESC, keyword_score DESC, vector_score DESC, document_id, chunk_id)::INT AS rank, count(*) OVER () AS total_candidates
    FROM (SELECT *, {alpha}::DOUBLE * vector_score + {1 - alpha}::DOUBLE * keyword_score AS hybrid_score
      FROM (SELECT document_id, chunk_id, coalesce(k.source_path, v.source_path) AS source_path, coalesce(k.raw_text, v.raw_text) AS raw_text, coalesce(k.cleaned_text, v.cleaned_text) AS cleaned_text,
          coalesce(k.raw_text_hash, v.raw_text_hash) AS raw_text_hash, coalesce(k.keyword_score, 0)::DOUBLE AS keyword_score, coalesce(v.vector_score, 0)::DOUBLE AS vector_score,
          coalesce(k.matched, '') AS matched_fields, k.keyword_score IS NOT NULL AS in_k, v.vector_score IS NOT NULL AS in_v
        FROM {kw} k FULL OUTER JOIN {vec} v USING (document_id, chunk_id))))
  WHERE rank <= {top}
)"""


RESULTS = f"{CORPUS}, {keyword('dual_context', 'kw')}, {vectors('vec')}, {merged('found', 0.5)}"
RESULTS += """, results AS (
  SELECT *, CASE WHEN in_k AND in_v THEN 'hybrid' WHEN in_k THEN 'keyword' ELSE 'vector_placeholder' END AS retrieval_source,
    CASE WHEN in_k AND in_v THEN 'keyword,vector_placeholder' WHEN in_k THEN 'keyword' ELSE 'vector_placeholder' END AS source_retrievers,
    CASE WHEN in_k AND in_v THEN 'hybrid' WHEN in_k THEN 'token_frequency' ELSE 'deterministic_placeholder' END AS score_policy
  FROM found
)"""


def judged(budget: EvidenceBudget, source: str = "results") -> str:
    """Greedy whole-item budget over rank-ordered rows, by recursion."""

    def reason(n, raw, cleaned, context, i):
        size = f"(length({i}.raw_text) + length({i}.cleaned_text))"
        return f"""CASE WHEN {n} + 1 > {budget.max_items} THEN 'max_items_exceeded' WHEN {raw} + length({i}.raw_text) > {budget.max_raw_chars} THEN 'max_raw_chars_exceeded'
      WHEN {cleaned} + length({i}.cleaned_text) > {budget.max_cleaned_chars} THEN 'max_cleaned_chars_exceeded' WHEN {context} + {size} > {budget.max_context_chars} THEN 'max_context_chars_exceeded' END"""

    return f"""numbered AS (SELECT *, row_number() OVER (ORDER BY rank) AS no FROM {source}), fold AS (
  SELECT 0::BIGINT AS no, 0::BIGINT AS n, 0::BIGINT AS raw, 0::BIGINT AS cleaned, 0::BIGINT AS ctx, NULL::VARCHAR AS reason
  UNION ALL
  SELECT no, n + (reason IS NULL)::BIGINT, raw + (reason IS NULL)::BIGINT * r, cleaned + (reason IS NULL)::BIGINT * c, ctx + (reason IS NULL)::BIGINT * (r + c), reason FROM (
    SELECT i.no, f.n, f.raw, f.cleaned, f.ctx, length(i.raw_text) AS r, length(i.cleaned_text) AS c, {reason("f.n", "f.raw", "f.cleaned", "f.ctx", "i")} AS reason
    FROM fold f JOIN numbered i ON i.no = f.no + 1)
), judged AS (SELECT i.*, f.reason, CASE WHEN f.reason IS NULL THEN row_number() OVER (PARTITION BY f.reason IS NULL ORDER BY i.rank)::INT END AS item_no FROM numbered i JOIN fold f USING (no) WHERE f.no > 0)"""


def context_block(raw: bool, cleaned: bool) -> str:
    parts = ["'[EVIDENCE ' || item_no || ']'", "'document_id: ' || document_id", "'chunk_id: ' || chunk_id", "'source_path: ' || source_path", "'retrieval_rank: ' || rank", "'retrieval_source: ' || retrieval_source", "'source_retrievers: ' || source_retrievers", "'raw_text_hash: ' || raw_text_hash", "'cleaned_text_hash: ' || sha256(cleaned_text)", "''"]
    parts += ["'RAW_TEXT:'", "raw_text", "''"] if raw else []
    parts += ["'CLEANED_TEXT:'", "cleaned_text", "''"] if cleaned else []
    return f"array_to_string([{', '.join(parts)}], chr(10))"


def packed(name: str, source: str, budget: EvidenceBudget | None, raw: bool, cleaned: bool) -> str:
    tail = "|".join([policy_hash(SelectionPolicy()), policy_hash(ContextPolicy(raw, cleaned)), policy_hash(budget) if budget else "no_budget"])
    return f"""{name} AS (SELECT sha256('run_1|{text_hash(QUERY)}|' || string_agg(document_id || ':' || chunk_id, '|' ORDER BY rank) FILTER (WHERE reason IS NULL) || '|{tail}') AS pack_id,
    string_agg({context_block(raw, cleaned)}, chr(10) ORDER BY rank) FILTER (WHERE reason IS NULL) AS context,
    count(*) AS total_input_results, count(*) FILTER (WHERE reason IS NULL)::INT AS total_selected_items, count(*) FILTER (WHERE reason IS NOT NULL)::INT AS total_excluded_items FROM {source})"""


PACK_COLUMNS = "pack_id, sha256(context) AS context_hash, length(context)::INT AS context_chars, total_input_results, total_selected_items, total_excluded_items"


def bounded(c: str) -> str:
    """c with every letter and mark beyond ASCII as `_`: DuckDB's `\\b` is ASCII, and no wanted match holds either."""
    for kind in ("L", "M"):
        c = f"regexp_replace({c}, '[^\\x00-\\x7F\\P{{{kind}}}]', '_', 'g')"
    return c


def words(c: str) -> str:
    return f"list_distinct(regexp_extract_all({bounded(f'lower({c})')}, '\\b[a-zA-Z]+\\b'))"


def numbers(c: str) -> str:
    return f"list_distinct(regexp_extract_all({bounded(c)}, '\\b\\d+\\.?\\d*\\b'))"


STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
CRITICAL = (
    r"\b\d+\.?\d*\b", r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d+\.\d+\.\d+\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b",
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", r"\b[a-z]+-[a-z]+-\d+-[a-z]+\b",
)


def critical(c: str) -> str:
    return "list_distinct(" + " || ".join(f"regexp_extract_all({bounded(c)}, '{p}')" for p in CRITICAL) + ")"


TEXT = "coalesce(text, '')"
ALTERED = f"""texts AS (
  SELECT doc_id, {TEXT} AS raw, CASE doc_id % 6 WHEN 0 THEN {TEXT} WHEN 1 THEN {TEXT} || ' zzunheard newword' WHEN 2 THEN {TEXT} || ' 987654321'
    WHEN 3 THEN regexp_replace({TEXT}, '[0-9]', '', 'g') WHEN 4 THEN substr({TEXT}, 1, (length({TEXT}) // 2)::INT) ELSE '' END AS cleaned
  FROM documents
), altered AS MATERIALIZED (
  SELECT *, {words('raw')} AS words_raw, {words('cleaned')} AS words_cleaned, {numbers('raw')} AS numbers_raw, {numbers('cleaned')} AS numbers_cleaned,
    {critical('raw')} AS critical_raw, {critical('cleaned')} AS critical_cleaned FROM texts
)"""


def minus(a: str, b: str) -> str:
    return f"list_filter({a}, lambda x: NOT list_contains({b}, x))"


def added(least: int) -> str:
    new = minus(minus("words_cleaned", "words_raw"), STOP)
    return f"list_sort(list_filter({new}, lambda x: length(x) >= {least}))"


NEW_NUMBERS = "list_sort(" + minus("numbers_cleaned", "numbers_raw") + ")"
GROWN = "(CASE WHEN length(raw) > 0 AND length(cleaned) > length(raw) THEN (length(cleaned) - length(raw))::DOUBLE / length(raw) * 100 ELSE 0 END)"
SHRUNK = "(CASE WHEN length(raw) > 0 THEN (length(raw) - length(cleaned))::DOUBLE / length(raw) * 100 ELSE 0 END)"
LOST = minus("critical_raw", "critical_cleaned")

# --- notes: the same rows and faults, written out by hand ---
HEADING = Branding().metadata_heading
PATH = "'wiki/' || lpad(doc_id::VARCHAR, 9, '0') || '.md'"
FAULTS = {
    3: [("invalid_note_type", "error")], 4: [("invalid_status", "error")], 5: [("invalid_validation_status", "warning")], 6: [("evidence_count_mismatch", "error")],
    7: [("claim_missing_citation", "error")], 8: [("citation_unresolved", "error")], 9: [("missing_metadata_section", "error")],
    10: [("duplicate_evidence_label", "error"), ("citation_unresolved", "error")], 11: [("evidence_missing_document_id", "error")], 12: [("invalid_source_policy", "error")],
    1: [("missing_frontmatter", "error"), ("orphan_note", "warning")], 2: [("malformed_frontmatter", "error"), ("orphan_note", "warning")],
}
_ROWS = " UNION ALL ".join(f"SELECT {k} AS fault, '{c}' AS code, '{s}' AS severity" for k, found in FAULTS.items() for c, s in found)
SHARED = f"shared AS (SELECT {PATH} AS file_path, min({PATH}) OVER () AS first_path FROM documents WHERE doc_id % 17 = 0 AND doc_id % 13 = 0)"
ISSUES = f"""{SHARED}, issues AS (
  SELECT {PATH} AS file_path, code, severity FROM documents JOIN ({_ROWS}) ON doc_id % 13 = fault
  UNION ALL SELECT file_path, 'duplicate_note_id', 'error' FROM shared WHERE file_path <> first_path
)"""

RENDERED = f"""notes AS (SELECT doc_id, 'note_' || doc_id AS note_id, sha256(text) AS h, lang FROM documents), rendered AS (
  SELECT *, concat_ws(chr(10), '---', 'note_id: "' || note_id || '"', 'note_type: "compiled_knowledge_wiki_note"', 'status: "proposal"', 'generated_at: "2024-01-02T03:04:05+00:00"', 'generated_by: "proofmill"',
    'generator_version: "0.1.0"', 'schema_version: "wiki-export-v1"', 'source_policy: "raw_text_authoritative"', 'validation_status: "validated"', CASE WHEN doc_id % 2 = 0 THEN 'confidence: "high"' END,
    'evidence_count: 3', 'source_documents:', '  - document_id: "doc_' || doc_id || '"', '    source_path: "src/' || lang || '/' || doc_id || '.md"', '    source_raw_hash: "' || h || '"', '    content_hash: "' || h || '"',
    'source_chunks:', '  - document_id: "doc_' || doc_id || '"', '    chunk_id: "chunk_doc_' || doc_id || '_0"', '    raw_text_hash: "' || h || '"', '---', '',
    '# Doc "' || doc_id || '": ' || lang, '', CASE WHEN doc_id % 7 = 0 THEN 'A summary.' || chr(10) END, '## Claims', '', '- First statement of ' || doc_id || ' [E1]', '- Second statement of ' || doc_id || ' [E1-2, E2, E1]',
    CASE WHEN doc_id % 5 = 0 THEN '- Open question of ' || doc_id || ' *(unsupported — no evidence)*' END, '', '## Evidence References', '',
    '### E1', '', '- **Document**: `doc_' || doc_id || '`', '- **Chunk**: `chunk_doc_' || doc_id || '_0`', '- **Source**: `src/' || lang || '/' || doc_id || '.md`', '- **Source Raw Hash**: `' || h || '`', '',
    '### E1-2', '', '- **Document**: `doc_' || doc_id || '`', '- **Chunk**: `chunk_doc_' || doc_id || '_1`', '- **Source Raw Hash**: `' || h || '`', '', '> first line', '>', '> last line', '',
    '### E2', '', '- **Document**: `doc_' || doc_id || '`', '- **Chunk**: `chunk_doc_' || doc_id || '_2`', '- **Source Raw Hash**: `' || h || '`', '',
    '---', '', '## {HEADING}', '', '- note_id: `' || note_id || '`', '- generated_at: "2024-01-02T03:04:05+00:00"', '- source_policy: "raw_text_authoritative"', '- validation_status: "validated"', '- evidence_count: 3',
    '- generator_version: "0.1.0"', '- schema_version: "wiki-export-v1"', '- source_documents:', '  - document_id: "doc_' || doc_id || '"', '- source_chunks:', '  - chunk_id: "chunk_doc_' || doc_id || '_0"', '') AS markdown
  FROM notes
)"""
HEX = "lower(hex(encode({c})))"
SLUG = "regexp_replace(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"

PLAN = """files AS (
  SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'NOTE' || (doc_id % 22) || '.md' ELSE lpad(doc_id::VARCHAR, 9, '0') || '.md' END AS name,
    CASE WHEN doc_id % 11 = 0 THEN 's' || doc_id || '/NOTE' || (doc_id % 22) || '.md' ELSE lpad(doc_id::VARCHAR, 9, '0') || '.md' END AS relative_source
  FROM documents
), plan AS (
  SELECT *, 'Vault/Notes/' || name AS relative_destination, first_value(relative_source) OVER (PARTITION BY lower(name) ORDER BY relative_source) <> relative_source AS rejected,
    'Vault/Notes/' || name IN (SELECT 'Vault/Notes/' || lpad(doc_id::VARCHAR, 9, '0') || '.md' FROM documents WHERE doc_id % 19 = 0) AS there
  FROM files
), listed AS (
  SELECT *, CASE WHEN doc_id % 13 IN (1, 2) THEN '' WHEN doc_id % 13 = 3 THEN 'diary' ELSE 'compiled_knowledge_wiki_note' END AS note_type,
    CASE WHEN doc_id % 13 = 2 THEN '' ELSE 'Doc "' || doc_id || '": ' || lang END AS title FROM plan WHERE NOT rejected AND NOT there
)"""

SQL = {
    "document_ids": f"WITH {DOCS} SELECT document_id, source_path, source_type, content_hash, size_bytes FROM docs",
    "manifest_diff": f"WITH {DOCS} SELECT document_id, source_path, CASE WHEN doc_id % 10 = 0 THEN 'new' WHEN doc_id % 10 = 1 THEN 'changed' ELSE 'unchanged' END AS status FROM docs",
    "ingest_summary": "SELECT count(*) AS total_files, count(*) FILTER (WHERE doc_id % 10 = 0) AS new_files, count(*) FILTER (WHERE doc_id % 10 = 1) AS changed_files, count(*) FILTER (WHERE doc_id % 10 > 1) AS unchanged_files, 0::BIGINT AS skipped_files, 0::BIGINT AS error_files FROM documents",
    "manifest_upsert": f"""WITH {DOCS} SELECT source_path, content_hash, size_bytes, 'now' AS last_ingested FROM docs
      UNION ALL SELECT 'removed/' || source_path, CASE WHEN doc_id % 10 = 1 THEN sha256(content_hash) ELSE content_hash END, size_bytes, '2024-01-01T00:00:00+00:00' FROM docs WHERE doc_id % 10 <> 0""",
    "content_duplicates": f"WITH {DOCS} SELECT document_id, content_hash AS raw_text_hash, row_number() OVER (PARTITION BY content_hash ORDER BY document_id) = 1 AS kept FROM docs",
    "chunks_default": f"WITH RECURSIVE {DOCS}, {chunks()} SELECT chunk_id, document_id, chunk_index, start_offset, end_offset, raw_text_hash FROM chunks",
    "chunks_overlap": f"WITH RECURSIVE {DOCS}, {chunks(size=400, overlap=60)} SELECT chunk_id, document_id, chunk_index, start_offset, end_offset, raw_text_hash FROM chunks",
    "chunks_hard": f"WITH {DOCS} SELECT document_id, ceil(length(raw_text) / 1000)::BIGINT AS chunks, length(raw_text)::INT AS length, (CASE WHEN length(raw_text) % 1000 = 0 THEN 1000 ELSE length(raw_text) % 1000 END)::INT AS least FROM docs WHERE length(raw_text) > 0",
    "chunk_stats": f"WITH RECURSIVE {DOCS}, {chunks()} SELECT document_id, count(*) AS total_chunks, max(end_offset)::BIGINT AS total_raw_chars, sum(length({refined('piece')}))::BIGINT AS total_cleaned_chars, 0 AS n_warnings, 'rule_based' AS refinement_method FROM chunks GROUP BY document_id",
    "chunk_integrity": f"WITH RECURSIVE {DOCS}, {chunks()} SELECT document_id, count(*) AS chunks, count(*) AS good FROM chunks GROUP BY document_id",
    "refine_noisy": f"WITH t AS (SELECT doc_id, {TABLED} AS raw FROM documents), r AS (SELECT doc_id, {refined('raw')} AS c FROM t) SELECT doc_id, sha256(c) AS cleaned_hash, length(c)::INT AS cleaned_length FROM r",
    "protected_lines": f"WITH t AS (SELECT doc_id, unnest(string_split({TABLED}, chr(10))) AS x FROM documents) SELECT doc_id, count(*) FILTER (WHERE {protected('x')}) AS protected_lines, count(*) AS lines FROM t GROUP BY doc_id",
    "safeguard": f"WITH {ALTERED} SELECT doc_id, CASE WHEN raw = '' THEN '' ELSE array_to_string({added(3)}, ',') END AS added_words, CASE WHEN raw = '' THEN '' ELSE array_to_string({NEW_NUMBERS}, ',') END AS added_numbers, round({GROWN}, 6)::DOUBLE AS length_expansion, raw <> '' AND cleaned = '' AS empty_cleaned, {GROWN} > 20 AS excessive_changes FROM altered",
    "guardrail_results": f"""WITH {ALTERED}, v AS (SELECT doc_id, CASE WHEN raw <> '' AND cleaned = '' THEN ['empty_cleaned_from_nonempty_raw'] ELSE list_filter([
      CASE WHEN raw <> '' AND len({NEW_NUMBERS}) > 0 THEN 'added_numbers' END, CASE WHEN raw <> '' AND len({added(4)}) > 0 THEN 'added_words' END, CASE WHEN len({LOST}) > 0 THEN 'critical_token_loss' END,
      CASE WHEN {GROWN} > 20 THEN 'excessive_expansion' END, CASE WHEN {GROWN} <= 20 AND {SHRUNK} > 30 THEN 'excessive_compression' END], lambda x: x IS NOT NULL) END AS found FROM altered)
      SELECT doc_id, len(found) = 0 AS passed, array_to_string(found, ',') AS violations FROM v""",
    "critical_tokens": f"WITH {ALTERED}, t AS (SELECT doc_id, list_sort(critical_raw) AS t FROM altered) SELECT doc_id, len(t)::INT AS n_tokens, array_to_string(t, ' ') AS tokens FROM t",
    "model_replies": "SELECT conv_id, turn, CASE conv_id % 5 WHEN 1 THEN 'Invalid JSON' WHEN 2 THEN 'Not a JSON object' WHEN 3 THEN 'Missing ''cleaned_text'' field' WHEN 4 THEN 'cleaned_text is not a string' END AS problem FROM conversations",
    "tokenize_stats": f"WITH {DOCS}, t AS (SELECT document_id, regexp_extract_all(lower(raw_text), {TOKENS}) AS t FROM docs) SELECT document_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct, len(list_filter(t, lambda x: x = 'the'))::INT AS n_the FROM t",
    "term_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {TOKENS})) AS token FROM documents) GROUP BY token",
    "keyword_topk": f"WITH RECURSIVE {CORPUS}, " + ", ".join(keyword(p, f"k{i}", limit=20) for i, p in enumerate(SEARCH)) + " " + " UNION ALL ".join(f"SELECT '{p}' AS policy, chunk_id, round(keyword_score, 6) AS keyword_score, matched FROM k{i}" for i, p in enumerate(SEARCH)),
    "vector_topk": f"WITH RECURSIVE {CORPUS}, {vectors('v', limit=20)} SELECT chunk_id, round(vector_score, 6) AS vector_score, 'vector_placeholder' AS retrieval_source, 'deterministic_placeholder' AS score_policy FROM v",
    "hybrid_topk": f"WITH RECURSIVE {CORPUS}, {keyword('dual_context', 'kw')}, {vectors('vec')}, " + ", ".join(merged(f"m{i}", a) for i, a in enumerate((0.0, 0.5, 1.0))) + " " + " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, rank, chunk_id, round(keyword_score, 6) AS keyword_score, round(vector_score, 6) AS vector_score, round(hybrid_score, 6) AS hybrid_score, total_candidates FROM m{i}" for i, a in enumerate((0.0, 0.5, 1.0))),
    "hybrid_filtered": f"""WITH RECURSIVE {CORPUS}, {keyword("raw_only", "kw", OTHER, "source_type = 'md' AND lang = 'fr'")}, {vectors("vec", OTHER, "source_type = 'md' AND lang = 'fr'")}, {merged("m", 0.5)} SELECT rank, chunk_id, round(hybrid_score, 6) AS hybrid_score, 'source_type=md, lang=fr' AS applied_filters FROM m""",
    "retrieval_trace": f"WITH RECURSIVE {RESULTS} SELECT rank, document_id, chunk_id, source_path, raw_text_hash, retrieval_source, source_retrievers, array_to_string(list_sort(string_split(matched_fields, ',')), ',') AS matched_fields, score_policy, sha256('{QUERY}') AS query_hash, 'run_1' AS retrieval_run_id FROM results",
    "batch_retrieval": f"""WITH RECURSIVE {CORPUS}, sized AS (SELECT document_id, chunk_id, regexp_extract_all(lower({SEARCH["dual_context"]}), {TOKENS}) AS t FROM corpus),
      wanted AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), {TOKENS})) AS token FROM benchmark) GROUP BY ALL),
      counts AS (SELECT document_id, chunk_id, n, token, count(*)::DOUBLE AS f FROM (SELECT document_id, chunk_id, len(t) AS n, unnest(t) AS token FROM sized) GROUP BY ALL),
      kw AS (SELECT query_id, document_id, chunk_id, least(1.0::DOUBLE, round(sum(times * (f * 1.5 / (f + 0.5))), 12) / (1.0::DOUBLE + n * 0.001::DOUBLE)) AS keyword_score FROM counts JOIN wanted USING (token) GROUP BY query_id, document_id, chunk_id, n),
      k2 AS (SELECT * FROM kw QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY keyword_score DESC, document_id, chunk_id) <= 10),
      vec AS (SELECT item_id AS query_id, document_id, chunk_id, ('0x' || substr(sha256(text || ':' || chunk_id), 1, 8))::BIGINT::DOUBLE / 4294967295.0::DOUBLE AS vector_score FROM benchmark CROSS JOIN corpus),
      v2 AS (SELECT * FROM vec QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY vector_score DESC, document_id, chunk_id) <= 10),
      b AS (SELECT query_id, document_id, chunk_id, coalesce(keyword_score, 0)::DOUBLE AS keyword_score, coalesce(vector_score, 0)::DOUBLE AS vector_score FROM k2 FULL OUTER JOIN v2 USING (query_id, document_id, chunk_id)),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 0.5 * vector_score + 0.5 * keyword_score DESC, keyword_score DESC, vector_score DESC, document_id, chunk_id)::INT AS rank FROM b)
      SELECT query_id, rank, chunk_id, round(keyword_score, 6) AS keyword_score, round(vector_score, 6) AS vector_score, round(0.5::DOUBLE * vector_score + 0.5::DOUBLE * keyword_score, 6) AS hybrid_score FROM r WHERE rank <= 5""",
    "embedding_topk": "WITH q AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id = 0 LIMIT 1), s AS (SELECT vec_id, coalesce(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), q) / nullif(sqrt(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(embedding, lambda x: x::DOUBLE))) * sqrt(list_dot_product(q, q)), 0), 0) AS score FROM embeddings, q) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 20",
    "pack_dedupe": f"""WITH RECURSIVE {RESULTS}, twice AS (SELECT rank, document_id, chunk_id, false AS again FROM results UNION ALL SELECT rank + 20, document_id, chunk_id, true FROM results),
      hashed AS (SELECT rank, chunk_id, raw_text_hash, row_number() OVER (PARTITION BY raw_text_hash ORDER BY rank) > 1 AS again FROM results)
      SELECT 'document_chunk' AS dedupe_key, rank, chunk_id, CASE WHEN again THEN 'duplicate_document_chunk' END AS reason, CASE WHEN again THEN 'duplicate of (document_id=' || document_id || ', chunk_id=' || chunk_id || ')' END AS detail FROM twice
      UNION ALL SELECT 'raw_text_hash', rank, chunk_id, CASE WHEN again THEN 'duplicate_raw_text_hash' END, CASE WHEN again THEN 'duplicate of raw_text_hash=' || raw_text_hash END FROM hashed""",
    "pack_max_items": f"WITH RECURSIVE {RESULTS} SELECT rank, chunk_id, CASE WHEN rank > 7 THEN 'max_items_exceeded' END AS reason, CASE WHEN rank <= 7 THEN rank END AS item_no FROM results",
    "pack_budget": f"WITH RECURSIVE {RESULTS}, {judged(BUDGET)} SELECT rank, chunk_id, reason, item_no FROM judged",
    "pack_exclusions": f"""WITH RECURSIVE {RESULTS}, firsts AS (SELECT *, row_number() OVER (PARTITION BY raw_text_hash ORDER BY rank) > 1 AS again FROM results), kept AS (SELECT * FROM firsts WHERE NOT again), {judged(BUDGET, "kept")},
      gone AS (SELECT rank, 'duplicate_raw_text_hash' AS reason, NULL::VARCHAR AS budget_field, 0 AS late FROM firsts WHERE again UNION ALL SELECT rank, reason, regexp_replace(reason, '_exceeded$', ''), 1 FROM judged WHERE reason IS NOT NULL),
      numbered2 AS (SELECT *, row_number() OVER (ORDER BY late, rank)::INT AS exclusion_no FROM gone) SELECT reason, budget_field, count(*) AS n, min(exclusion_no) AS first_no FROM numbered2 GROUP BY reason, budget_field""",
    "pack_context": f"WITH RECURSIVE {RESULTS}, {judged(BUDGET)}, plain AS (SELECT *, NULL AS reason, rank AS item_no FROM results), {packed('p1', 'judged', BUDGET, True, True)}, {packed('p2', 'plain', None, True, False)} SELECT {PACK_COLUMNS} FROM p1 UNION ALL SELECT {PACK_COLUMNS} FROM p2",
    "pack_json": f"WITH RECURSIVE {RESULTS}, {judged(BUDGET)}, {packed('p1', 'judged', BUDGET, True, True)} SELECT pack_id, sha256(context) AS context_hash, total_selected_items AS items, total_excluded_items AS excluded FROM p1",
    "slugs": f"WITH t AS (SELECT p_partkey, '  ' || p_name || ': ' || p_brand || '!' AS title FROM part) SELECT p_partkey, {SLUG.format(c='title')} AS slug, {SLUG.format(c='title')} || '--id-' || {HEX.format(c="('Note ' || p_partkey)")} || '.md' AS file_name FROM t",
    "note_render": f"WITH {RENDERED} SELECT note_id, 'doc-' || doc_id || '-' || lang || '--id-' || {HEX.format(c='note_id')} || '.md' AS file_name, length(markdown)::INT AS chars, sha256(markdown) AS markdown_hash FROM rendered",
    "note_export": "SELECT 'note_' || doc_id AS note_id, CASE WHEN doc_id % 3 = 1 THEN 'Note is not validated' WHEN doc_id % 4 = 2 THEN 'note_id mismatch: note.note_id ''note_' || doc_id || ''' does not match metadata.note_id ''other''' WHEN doc_id % 5 = 0 THEN 'Unsupported claim: ''Open question of ' || doc_id || '''' END AS rejection_reason FROM documents",
    "lint_issues": f"WITH {ISSUES} SELECT file_path, code, severity FROM issues",
    "lint_report": f"WITH {ISSUES} SELECT (SELECT count(*) FROM documents) AS files_scanned, count(*) FILTER (WHERE severity = 'error') AS error_count, count(*) FILTER (WHERE severity = 'warning') AS warning_count, count(*) FILTER (WHERE severity = 'error') = 0 AS passed FROM issues",
    "citation_unresolved": f"SELECT {PATH} AS file_path, 'citation_unresolved' AS code, 'Citation [' || (CASE WHEN doc_id % 13 = 8 THEN 'E7' ELSE 'E2' END) || '] in claim is not found in evidence references' AS message FROM documents WHERE doc_id % 13 IN (8, 10) UNION ALL SELECT {PATH}, 'evidence_count_mismatch', 'evidence_count is 9 but found 3 evidence section(s) in body' FROM documents WHERE doc_id % 13 = 6",
    "duplicate_note_id": f"WITH {SHARED} SELECT file_path, 'Duplicate note_id ''note_shared'' in ''' || first_path || ''' and ''' || file_path || '''' AS message FROM shared WHERE file_path <> first_path",
    "source_drift": f"""WITH ok AS (SELECT doc_id, {PATH} AS file_path FROM documents WHERE doc_id % 13 NOT IN (1, 2)) SELECT 'source_hash_missing_expected' AS code, file_path, 1::BIGINT + (doc_id % 4 = 0)::BIGINT AS n FROM ok
      UNION ALL SELECT 'source_hash_mismatch', file_path, 1::BIGINT FROM ok WHERE doc_id % 4 <> 0 AND doc_id % 3 = 0""",
    "vault_plan": f"WITH {PLAN} SELECT relative_source, relative_destination, rejected, rejected AS collision, there AND NOT rejected AS skipped FROM plan",
    "index_by_type": f"WITH {PLAN} SELECT CASE WHEN note_type = '' THEN 'unknown' ELSE note_type END AS \"group\", count(*)::INT AS n FROM listed GROUP BY 1",
    "index_by_source": f"""WITH {PLAN}, l AS (SELECT CASE WHEN doc_id % 13 = 2 THEN '<no-source>' ELSE 'doc_' || doc_id END AS g, relative_source, title, '- [[' || name || '|' || (CASE WHEN title <> '' THEN title ELSE name END) || ']]' AS line FROM listed)
      SELECT g AS "group", count(*)::INT AS n, string_agg(line, chr(10) ORDER BY title, relative_source) AS lines FROM l GROUP BY g""",
    "conversation_chunks": f"""WITH RECURSIVE docs AS (SELECT 'doc_' || substr(sha256(source_path), 1, 12) || '_' || substr(sha256(raw_text), 1, 12) AS document_id, * FROM (SELECT 'conv/' || conv_id || '/' || turn || '.txt' AS source_path, coalesce(text, '') AS raw_text FROM conversations)), {chunks(size=300)}
      SELECT path AS source_path, chunk_id, start_offset, end_offset, raw_text_hash FROM chunks""",
    "page_sources": """WITH p AS (SELECT 'pages/' || page_id || (CASE page_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.html' ELSE '.markdown' END) AS source_path, page_id, html FROM pages)
      SELECT 'doc_' || substr(sha256(source_path), 1, 12) || '_' || substr(sha256(coalesce(html, '')), 1, 12) AS document_id, source_path, CASE WHEN page_id % 3 = 1 THEN 'txt' ELSE 'md' END AS source_type, page_id % 3 <> 1 AS supported, octet_length(encode(coalesce(html, '')))::BIGINT AS size_bytes FROM p""",
}
SQL["retrieval_quality"] = f"""WITH RECURSIVE {CORPUS}, sized AS (SELECT document_id, chunk_id, regexp_extract_all(lower({SEARCH["dual_context"]}), {TOKENS}) AS t FROM corpus),
  wanted AS (SELECT query_id, token, count(*) AS times FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), {TOKENS})) AS token FROM benchmark) GROUP BY ALL),
  counts AS (SELECT document_id, chunk_id, n, token, count(*)::DOUBLE AS f FROM (SELECT document_id, chunk_id, len(t) AS n, unnest(t) AS token FROM sized) GROUP BY ALL),
  kw AS (SELECT query_id, document_id, chunk_id, least(1.0::DOUBLE, round(sum(times * (f * 1.5 / (f + 0.5))), 12) / (1.0::DOUBLE + n * 0.001::DOUBLE)) AS s FROM counts JOIN wanted USING (token) GROUP BY query_id, document_id, chunk_id, n),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, document_id, chunk_id) AS rank FROM kw),
  truth AS (SELECT DISTINCT item_id AS query_id, document_id FROM docs JOIN benchmark b ON contains(raw_text, b.text)),
  hit AS (SELECT query_id, document_id, min(rank) AS rank FROM r JOIN truth USING (query_id, document_id) WHERE rank <= 5 GROUP BY ALL),
  per AS (SELECT query_id, count(*) AS hits, min(rank) AS first FROM hit GROUP BY query_id), w AS (SELECT query_id, count(*) AS wanted FROM truth GROUP BY query_id)
  SELECT query_id, round(coalesce(hits, 0) / wanted, 6) AS recall, round(coalesce(hits, 0) / 5, 6) AS precision, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank FROM w LEFT JOIN per USING (query_id)"""
