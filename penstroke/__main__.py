from penstroke.cli import main

raise SystemExit(main())
