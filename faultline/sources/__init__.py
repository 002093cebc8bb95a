"""Line sources (text files, tables, the test fixture) and sinks."""

from faultline.sources.lines import (  # noqa: F401
    FIXTURE_FAULT_DOC, FIXTURE_FAULT_DOCS_TWO, FIXTURE_INJECT_EVERY, FIXTURE_PHRASE,
    fixture_lines, lines_from_table, load_table, read_lines, write_lines,
)
