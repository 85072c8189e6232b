"""Column functions with PostgreSQL-flavoured semantics, built from JVM expressions only."""

from .arrays import *  # noqa: F403
from .json import *  # noqa: F403
from .math import *  # noqa: F403
from .strings import *  # noqa: F403
from .times import *  # noqa: F403
