"""Equal notices that follow each other closely are all found."""

import pyarrow as pa
import pytest

from geoloom.llm import license_scan
from geoloom.llm.license_texts import TEMPLATES


@pytest.mark.parametrize("name", ["notice:MIT", "notice:CC-BY-4.0", "notice:Apache-2.0", "notice:GPL-3.0"])
@pytest.mark.parametrize("between", range(14))
@pytest.mark.parametrize("times", [2, 5])
def test_run_of_equal_notices(name, between, times):
    index = license_scan.Index({name: TEMPLATES[name]})
    size = len(index.template(0))
    text = "some words " + " ".join([TEMPLATES[name] + " other" * between] * times)
    found = license_scan.matches(license_scan.folded(pa.array([text])), index)[0]
    assert [(m.begin, m.end, m.matched) for m in found] == [(2 + k * (size + between), 2 + k * (size + between) + size, size) for k in range(times)]
