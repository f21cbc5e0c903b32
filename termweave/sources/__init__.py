"""Sheets, indexes, encoders, model clients, review sheets, exports."""

from .clients import client
from .encoders import HashedNgrams, LateInteraction, Transformer, encoded, encoder, resolved_device
from .exports import beside_input, block_cells, write_all
from .files import read_index, read_manifest, read_sheet, write_index
from .usagi import COLUMNS as REVIEW_COLUMNS
from .usagi import invalid_rows, is_review_sheet, review_rows

__all__ = ["HashedNgrams", "LateInteraction", "REVIEW_COLUMNS", "Transformer", "beside_input", "block_cells", "client", "encoded", "encoder", "invalid_rows", "is_review_sheet", "read_index", "read_manifest", "read_sheet", "resolved_device", "review_rows", "write_all", "write_index"]
