"""Transaction analytics on Spark."""

from tallyline.functions import *  # noqa: F401,F403
from tallyline.operators import *  # noqa: F401,F403
from tallyline.plans import *  # noqa: F401,F403
from tallyline.session import build_session, shared  # noqa: F401
from tallyline.sources import *  # noqa: F401,F403
from tallyline.streaming import *  # noqa: F401,F403
