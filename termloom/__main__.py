from termloom.app import main

main()
