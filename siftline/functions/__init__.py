"""Column functions."""

from siftline.functions.code import ast_features, extract_functions
from siftline.functions.text import md5_hex, rstrip, split_lines, strip
from siftline.functions.tokens import tokenize_bug_aware, tokenize_legacy

__all__ = [
    "ast_features",
    "extract_functions",
    "md5_hex",
    "rstrip",
    "split_lines",
    "strip",
    "tokenize_bug_aware",
    "tokenize_legacy",
]
