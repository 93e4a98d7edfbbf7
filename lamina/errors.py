"""Coded errors: `code` is part of the interface."""

from __future__ import annotations


class EngineError(Exception):
    code = "INTERNAL"


def _coded(name: str, code: str, doc: str) -> type[EngineError]:
    return type(name, (EngineError,), {"code": code, "__doc__": doc, "__module__": __name__})


InvalidGrid = _coded("InvalidGrid", "INVALID_GRID", "Sizes are not an ascending chain of divisors.")
SlicingError = _coded("SlicingError", "SLICING_ERROR", "The text or its id cannot be sliced.")
UnknownTokenizer = _coded("UnknownTokenizer", "UNKNOWN_TOKENIZER", "No such token counter.")
StoreUnavailable = _coded("StoreUnavailable", "STORE_UNAVAILABLE", "No size of the corpus can be searched.")
CorpusNotFound = _coded("CorpusNotFound", "CORPUS_NOT_FOUND", "No such corpus.")
CorpusExists = _coded("CorpusExists", "CORPUS_EXISTS", "The corpus is there already.")
EmbedderMismatch = _coded("EmbedderMismatch", "EMBEDDER_MISMATCH", "Data of another grid, dimension or embedder.")
DocumentNotFound = _coded("DocumentNotFound", "DOCUMENT_NOT_FOUND", "No such document.")
DocumentTooLarge = _coded("DocumentTooLarge", "DOCUMENT_TOO_LARGE", "The text exceeds the length limit.")
EmbedderUnavailable = _coded("EmbedderUnavailable", "EMBEDDER_UNAVAILABLE", "The embedder gave no usable answer.")
ValidationError = _coded("ValidationError", "VALIDATION_ERROR", "An argument is outside its range.")
BatchTooLarge = _coded("BatchTooLarge", "BATCH_TOO_LARGE", "More documents than a batch may hold.")
