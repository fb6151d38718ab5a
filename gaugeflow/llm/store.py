"""Scratch tables in the cluster's shared folder and bounds on Arrow batches, as the library has them."""

from ..sources.scratch import collecting, forget, release, scratch_dir, written
from ..sources.workers import bound_batches

__all__ = ["bound_batches", "collecting", "forget", "release", "scratch_dir", "written"]
