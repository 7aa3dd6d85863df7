"""All registered queries; importing this module registers them."""

from veil.plans import chats, screens, sessions, settings, streams, texts  # noqa: F401
from veil.plans.registry import ORACLES, QUERIES  # noqa: F401
