"""Errors with a stable code and a status."""

from __future__ import annotations


class EngineError(Exception):
    code, status = "internal_error", 500


class CollectionExists(EngineError):
    code, status = "collection_exists", 409


class CollectionNotFound(EngineError):
    code, status = "collection_not_found", 404


class DocumentNotFound(EngineError):
    code, status = "document_not_found", 404


class SchemaError(EngineError):
    code, status = "invalid_schema", 400


class DocumentError(EngineError):
    code, status = "invalid_document", 400


class QueryError(EngineError):
    code, status = "invalid_query", 400


class CorruptData(EngineError):
    code, status = "corrupt_data", 500
