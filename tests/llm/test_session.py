"""An operator in a session that names no shared folder."""

from tests.test_session import run_without_a_preset_folder


def test_a_laptop_needs_no_setting():
    assert run_without_a_preset_folder("op7_simhash") == [200]
