"""Where the vocabulary files of public tokenizers lie."""

from __future__ import annotations

import os

import public_tokenizers


def vocabulary(name: str) -> str:
    """Path of a vocabulary file: in the folder TOKENIZER_DIR names, else in the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)
