import numpy as np
import pyarrow as pa

from lumenweave.functions.kernels import block_of_spectra, spectra_block


def test_blocks_of_slices_nulls_and_odd_lengths():
    rows = [[1.0, 2.0], None, [3.0, None], [4.0], [5.0, 6.0], []]
    col = pa.array(rows, pa.list_(pa.float32()))
    want = np.array([[1, 2], [np.nan] * 2, [3, np.nan], [np.nan] * 2, [5, 6], [np.nan] * 2])
    assert np.array_equal(spectra_block(col, 2), want, equal_nan=True)
    assert np.array_equal(spectra_block(col.slice(2, 3), 2), want[2:5], equal_nan=True)
    assert np.array_equal(spectra_block(pa.chunked_array([col.slice(0, 2), col.slice(4)]), 2), want[[0, 1, 4, 5]], equal_nan=True)
    assert spectra_block(col.slice(0, 0), 2).shape == (0, 2) and np.isnan(spectra_block(col.slice(3, 1), 2)).all()


def test_back_to_arrow():
    block = np.array([[1.0, np.nan], [2.0, 3.0]])
    assert block_of_spectra(block).to_pylist() == [[1.0, None], [2.0, 3.0]]
    assert block_of_spectra(block, np.array([True, False])).to_pylist() == [[1.0, None], None]
