"""Series and result readers, and the sinks of results."""

from permuta.sources.files import file_digests, write_named_files  # noqa: F401
from permuta.sources.readers import (  # noqa: F401
    read_benchmark,
    read_canonical,
    read_methods,
    read_runs,
    read_semicolon_csv,
    read_text_series,
)
from permuta.sources.series import base_table, number_rows, positions, previous_values, with_lengths  # noqa: F401
from permuta.sources.sinks import (  # noqa: F401
    canonical_lines,
    checksum_manifest,
    digest_list,
    number_lines,
    write_canonical,
    write_canonical_files,
    write_client_report,
    write_number_text,
    write_summary,
)
