"""Named queries over the driver's tables; importing this package registers them."""

from signal_engine.plans import business, campaign, choices, connectors, inventory, rules, selection, signals, streams, web  # noqa: F401
