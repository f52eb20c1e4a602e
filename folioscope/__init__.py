"""folioscope: paper ranking, feedback ledgers and ranking evaluation as Spark jobs."""

from folioscope.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
