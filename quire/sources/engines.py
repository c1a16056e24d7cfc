"""OCR engines and PDF parsers that a machine may have. Engines are looked for where they run, on the executors."""

from __future__ import annotations

import importlib.util
import shutil
import subprocess
from collections.abc import Callable


def tesseract(command: str | None = None) -> Callable[[bytes], str] | None:
    """Reads pictures by the tesseract program, if there is one."""
    found = shutil.which(command or "tesseract")
    if found is None:
        return None

    def read(image: bytes) -> str:
        done = subprocess.run([found, "stdin", "stdout", "-l", "eng"], input=image, capture_output=True, timeout=120, check=False)
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""

    return read


def rapid(least: float = 0.55) -> Callable[[bytes], str] | None:
    """Reads pictures by a local ONNX pipeline, if its package is installed; lines it is unsure of are dropped."""
    if importlib.util.find_spec("rapidocr_onnxruntime") is None:
        return None
    from rapidocr_onnxruntime import RapidOCR

    held = RapidOCR()

    def read(image: bytes) -> str:
        lines, _ = held(image)
        return "\n".join(text for _, text, score in lines or () if text.strip() and float(score) >= least)

    return read


_FOUND: list = []


def best(image: bytes) -> str:
    """The first engine that reads anything; without engines nothing is read. Engines are looked for once a worker."""
    if not _FOUND:
        _FOUND.append([e for e in (tesseract(), rapid()) if e is not None])
    for engine in _FOUND[0]:
        if read := engine(image).strip():
            return read
    return ""


def name() -> str:
    """The engine that this machine would use."""
    return "tesseract" if shutil.which("tesseract") else "rapidocr" if importlib.util.find_spec("rapidocr_onnxruntime") else "none"


def pypdf_pages(content: bytes) -> list[tuple[int, str, bool, bytes | None]]:
    """Pages of a PDF file by pypdf: number, text, whether there are pictures, and the largest one. A file that can't be
    read has none."""
    from io import BytesIO

    from pypdf import PdfReader
    from pypdf.errors import PyPdfError

    try:
        out = []
        for number, page in enumerate(PdfReader(BytesIO(content)).pages, 1):
            images = [bytes(x.data) for x in page.images]
            out.append((number, page.extract_text() or "", bool(images), max(images, key=len, default=None)))
        return out
    except PyPdfError:
        return []


def pdf_parser() -> Callable[[bytes], list[tuple[int, str, bool, bytes | None]]] | None:
    """The parser of the library that is installed, if there is one. Executors need the same library."""
    return pypdf_pages if importlib.util.find_spec("pypdf") else None
