"""Traceable document analytics on PySpark; public names load their modules on first use."""

from importlib import import_module

_PUBLIC = {
    "config": "Branding ChunkConfig ContextPolicy EvidenceBudget MetadataFilter RetrievalRequest SelectionPolicy Settings get_settings reload_settings",
    "interfaces": "ModelAdapter PackBuilder ReasoningEngine Retriever StorageBackend Validator",
    "operators.chunk": "chunk",
    "operators.health": "cross_issues drift_issues lint parse report report_json",
    "operators.notes": "export_plan render validate write_notes",
    "operators.pack": "build_pack deduplicate exclusions from_json select_items to_json",
    "operators.refine": "check_facts clean_chunks document_rollup guardrails refine_chunks refine_with_model result_json",
    "operators.retrieve": "HybridPipeline apply_filter create_pipeline embedding_hits keyword_hits quality retrieve retrieve_batch vector_hits",
    "operators.vault": "VaultConfig apply grouped_links index_page manifest note_files plan",
    "sources.files": "ingest list_files load_files normalize",
    "sources.http_model": "HttpModel",
    "sources.manifest": "diff load remove source_hashes summary upsert",
    "sources.store": "ChunkStore",
    "sources.tables": "corpus table_documents text_documents",
    "streaming.incremental": "ingest_stream latest",
}
_HOME = {name: module for module, names in _PUBLIC.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)


def __dir__():
    return [*globals(), *__all__]
